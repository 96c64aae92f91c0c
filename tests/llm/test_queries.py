"""The queries opN_<name> on small tables with awkward rows, against brute force."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from test_corpus_ops import brute_components, brute_losses
from trackloom.llm import chat, html, langid, media, queries, secrets, sharding
from trackloom.llm import text as tx

ITEM = "a passage of the benchmark which is surely long enough to be found again in any document that holds it"
CLASHING = ("key", "rep", "score", "span", "spans", "hash", "comp", "part", "bucket", "length", "slab", "size")


def _rows():
    r = random.Random(12)
    syllables = {"aa": ["ka", "ta", "na", "sa"], "bb": ["bru", "gru", "dru", "fru"]}
    say = lambda lang, n: " ".join("".join(r.choices(syllables[lang], k=r.randint(1, 3))) for _ in range(n))
    rows = [(k, say("ab"[k % 2] * 2, r.randint(3, 60)), "ab"[k % 2] * 2, f"s{k % 5}") for k in range(70)]
    rows += [(100 + k, rows[4][1], "aa", "s1") for k in range(6)]  # copies
    rows += [(200, None, "aa", None), (201, "", "bb", "s1"), (202, " \t\n", None, "s1"), (203, "12 ?! 34", "aa", "s2"), (204, "one two", "aa", "s2"), (205, "ONE  two", "aa", "s2")]
    rows += [(300, f"{say('aa', 5)} {ITEM.upper()} {say('aa', 9)}", "aa", "s3"), (301, 'token = "0123abcd4567ef89aa" é AKIA' + "Q" * 18 + " <|endoftext|> x", None, "s3")]
    rows += [(302, "passwd=short secret:" + "x" * 11 + " api-key: aaaabbbbccccdddd0 token='" + "0" * 40, None, None)]
    rows += [(400, say("aa", 40_000), "aa", "s4"), (401, "0123456789abcdef " * 300, "bb", "s4"), (402, "x" * 100_000, None, "s4")]
    return [*rows, rows[7]]  # and one row twice


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """Tables with columns that have the names of working columns, and the same without rows."""
    root, rows = tmp_path_factory.mktemp("tables"), _rows()
    more = ", ".join(f"{k} string" for k in CLASHING)
    made = {
        "documents": ([(*x, None if x[1] is None else len(x[1]), *CLASHING) for x in rows], f"doc_id bigint, text string, lang string, source string, n_chars bigint, {more}"),
        "labels": ([(k, int(k % 3 == 0), 0) for k in range(60)] + [(0, 1, 0), (None, 1, 0)], "doc_id bigint, quality int, toxic int"),
        "benchmark": ([(1, ITEM), (2, None), (3, ""), (1, ITEM)], "item_id bigint, text string"),
        "pages": ([(1, "u", "<nav><a>Menu</a></nav><article><p>Body it's</p><p title=it's>More</p></article>"), (2, None, None), (3, "u", "")], "page_id bigint, url string, html string"),
        "conversations": ([(1, 0, "user\\\x00\x01", "hi <|im_end|>"), (1, 1, "assistant", None), (None, None, None, None), (2, 0, "assistant", "a"), (2, 0, "assistant", "a")], "conv_id bigint, turn bigint, role string, text string"),
    }
    for name, (data, schema) in made.items():
        spark.createDataFrame(data, schema).write.parquet(str(root / "full" / f"{name}.parquet"))
        spark.createDataFrame([], schema).write.parquet(str(root / "empty" / f"{name}.parquet"))
    return rows, root


def run(spark, tables, name):
    return queries.QUERIES[name](spark, str(tables[1] / "full")).collect()


@pytest.mark.parametrize("name", list(queries.QUERIES))
def test_empty_tables(spark, tables, name):
    out = queries.QUERIES[name](spark, str(tables[1] / "empty")).collect()
    assert [r.conv_id for r in out] == [-1] if name.startswith("op8") else out == []


def test_op1(spark, tables):
    assert {r.page_id: (r.url, r.text, r.n_chars) for r in run(spark, tables, "op1_recurrent_main_text")} == {1: ("u", "Body it's\nMore", 14), 2: (None, "", 0), 3: ("u", "", 0)}


def test_op2(spark, tables):
    assert [(r.doc_id, r.item_id, r.edits) for r in run(spark, tables, "op2_qgram_decontamination")] in ([(300, 1, 0)], [(300, 1, 0), (300, 1, 0)])


def test_op3(spark, tables):
    rows, out = tables[0], run(spark, tables, "op3_vector_bin_sharding")
    want = Counter((d, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t, *_ in rows)
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in out) == want
    slots: dict[int, list[int]] = {}
    for r in out:
        slots.setdefault(r.shard, []).append(r.slot)
        assert 0 <= r.shard < 16 and r.law == "bytes"
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())


def test_plan_is_a_placement_by_the_dot_product():
    """Classes of one group each: every group goes where weights, its vector and the residual capacity fit best."""
    r = np.random.default_rng(5)
    size = r.integers(1, 1000, (60, 3)).astype(float)
    totals = size.sum(axis=0)
    left, want = [list(totals / 8) for _ in range(8)], {}
    scale = totals / 8
    for k in sorted(range(60), key=lambda k: (-max(size[k] / scale), f"c{k:02}")):
        fit = [sum(w * (x / s) * (v / s) for w, x, v, s in zip(sharding.WEIGHTS, left[b], size[k], scale, strict=True)) for b in range(8)]
        best = max(range(8), key=lambda b: (fit[b], -b))
        want[f"c{k:02}"] = best
        left[best] = [x - v for x, v in zip(left[best], size[k], strict=True)]
    assert {c: b for c, _, _, b in sharding.plan([(f"c{k:02}", 1, *size[k]) for k in range(60)], totals, 8)} == want


def test_op4(spark, tables):
    rows = tables[0]
    out = run(spark, tables, "op4_cross_entropy_difference")
    few = [x for x in zip(rows, brute_losses_of(rows), strict=True) if x[0][0] < 400]
    near = lambda d, n, b, t: (d, n, round(b, 8), round(t, 8))
    got = Counter(near(r.doc_id, r.n_tokens, r.background_loss, r.target_loss) for r in out)
    assert len(out) == len(rows) and all(got[near(x[0], *loss)] for x, loss in few)


def brute_losses_of(rows):
    """Only documents before the long ones are scored one by one; the long ones count."""
    from test_corpus_ops import Counted

    good = {k for k in range(60) if k % 3 == 0}
    words = [re.findall(r"[^\x20\x09-\x0D]+", (t or "").lower()) for _, t, *_ in rows]
    known = sorted(w for w, n in Counter(w for ws in words for w in ws).items() if n >= 2)
    name = {w: w for w in known}
    models = [Counted(words, known), Counted([ws for ws, x in zip(words, rows, strict=True) if x[0] in good], known)]
    for (d, *_), ws in zip(rows, words, strict=True):
        if d >= 400:
            yield None
            continue
        named, out = [*(name.get(w, "?") for w in ws), "</s>"] if ws else [], []
        for m, model in enumerate(models):
            off = m == 0 or d in good
            single, pairs = Counter(named) if off else Counter(), Counter(zip(named, named[1:], strict=False)) if off else Counter()
            size, total = model.size - sum(single.values()), 0.0
            for v, w in zip([None, *named], named, strict=False):
                p = (model.single[w] - single[w] + 1) / size
                n = model.single[v] - single[v] if v is not None else 0
                total -= math.log(0.7 * (model.pairs[v, w] - pairs[v, w]) / n + 0.3 * p if n else p)
            out.append(total / (len(ws) + 1))
        yield (len(ws), *out)


def test_brute_losses_agree():
    rows = [(k, t) for k, t, *_ in _rows()[:30]]
    good = {k for k in range(60) if k % 3 == 0}
    assert [tuple(round(v, 9) for v in x) for x in brute_losses(rows, good)] == [tuple(round(v, 9) for v in x) for x in brute_losses_of([(*x, None, None) for x in rows])]


def test_op5(spark, tables):
    rows = tables[0]
    want = brute_components(list({d: t for d, t, *_ in rows}.items()))
    out = run(spark, tables, "op5_tensored_minhash")
    assert len(out) == len(rows) and {r.doc_id: (r.n_shingles, r.component_id) for r in out} == want and all(r.kept == (r.doc_id == r.component_id) for r in out)


def _direct_hash(payload: bytes) -> str:
    """The cosine hash by its definition: cells averaged one by one, coefficients summed one by one."""
    grey = np.frombuffer(payload, np.uint8).reshape(-1, 24).astype(float)
    edges = lambda n, k: (k * n // 32, max(k * n // 32 + 1, (k + 1) * n // 32))
    cells = np.array([[grey[slice(*edges(len(grey), y)), slice(*edges(24, x))].mean() for x in range(32)] for y in range(32)])
    wave = lambda k, x: math.cos(math.pi * k * (2 * x + 1) / 64)
    low = [sum(cells[y, x] * wave(u, y) * wave(v, x) for y in range(32) for x in range(32)) for u in range(8) for v in range(8)]
    low = [round(x, 6) for x in low]
    middle = float(np.median(low[1:]))
    return f"{int(''.join('1' if x > middle else '0' for x in low), 2):016x}"


def test_op6(spark, tables):
    rows = {d: t for d, t, *_ in tables[0]}
    out = run(spark, tables, "op6_png_media")
    assert Counter(r.doc_id for r in out) == Counter(x[0] for x in tables[0])
    for r in out:
        body = (rows[r.doc_id] or "").encode()
        payload = body + b"\xff" * (-len(body) % 576 if body else 576)
        image = media.write(payload)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(body), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))
        assert (r.media_bytes, r.media_sha256) == (len(image), hashlib.sha256(image).hexdigest())
        if r.doc_id in (3, 200, 302, 401):
            assert r.feature == _direct_hash(payload)


def test_damaged_images_raise_value_errors():
    import struct

    good = media.write(media.pad(b"abc" * 400))
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    header = struct.pack(">IIBBBBB", 24, 24, 8, 0, 0, 0, 0)
    image = lambda h, body: media.SIGNATURE + chunk(b"IHDR", h) + chunk(b"IDAT", body) + chunk(b"IEND", b"")
    for bad in (b"", good[:-5], good[:40], image(header[:5], zlib.compress(b"x")), image(header, b"no stream"), image(header, zlib.compress(b"x" * 600)), image(header, zlib.compress(b"\0" * 10**7)), image(header, zlib.compress(b"\0" * 600)[:-4]), image(struct.pack(">IIBBBBB", 0, 0, 8, 0, 0, 0, 0), zlib.compress(b""))):
        with pytest.raises(ValueError):
            media.read(bad)


def test_op7(spark, tables):
    """Profiles, distances and scores by counting; n-grams themselves have a test of their own."""
    rows = tables[0]

    def ranked(texts):
        count: Counter = Counter()
        for t in texts:
            raw = np.frombuffer((t or "").encode(), np.uint8)
            count.update(langid.grams(raw, np.array([0, len(raw)]))[1].tolist())
        return [g for g, _ in sorted(count.items(), key=lambda x: (-x[1], x[0]))[: langid.TOP]]

    held = lambda d: zlib.crc32(str(d).encode()) % 4 == 2
    langs = sorted({x[2] for x in rows if x[2]})
    profiles = {lang: {g: k for k, g in enumerate(ranked([t for d, t, own, _ in rows if own == lang and not held(d)]))} for lang in langs}
    out = run(spark, tables, "op7_rank_order_language")
    assert len(out) == len(rows)
    texts = {d: t for d, t, *_ in rows}
    for r in out:
        own = ranked([texts[r.doc_id]])
        far = {lang: sum(abs(p[g] - k) if g in p else langid.TOP for k, g in enumerate(own)) for lang, p in profiles.items()}
        best = min(langs, key=lambda x: far[x])
        want = (best, 1 - far[best] / (len(own) * langid.TOP)) if own else ("und", 0.0)
        assert (r.held_out, r.lang_pred) == (held(r.doc_id), want[0]) and abs(r.score - want[1]) < 1e-12


def test_counts_beyond_a_key_keep_their_order(monkeypatch):
    r = random.Random(2)
    column = ["".join(r.choices("abcdefg  ", k=400)) for _ in range(20)]
    ranker = langid.Ranker({"x": list(range(5)), "y": langid.counted(*langid.grams(*_slab(column[:1])))[1][:50].tolist()})
    usual = ranker.predict(*_slab(column))
    monkeypatch.setattr(langid, "MOST", 2)
    assert all((a == b).all() for a, b in zip(usual, ranker.predict(*_slab(column)), strict=True))


def _slab(texts):
    import pyarrow as pa

    return next(tx.slabs(pa.array(texts)))[2:]


def test_op8(spark, tables):
    out = {r.conv_id: r for r in run(spark, tables, "op8_chat_parts")}
    digest = lambda *turns: hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in turns).encode()).hexdigest()
    said = "<|im_end|><|im_start|>assistant ok"
    assert out[-1].turns_sha256 == digest(("user", said), ("assistant", said)) and out[-1].loss_sha256 == hashlib.sha256(said.encode()).hexdigest()
    assert out[1].turns_sha256 == digest(("user\\\x00\x01", "hi <|im_end|>"), ("assistant", "")) and out[1].loss_chars == 0
    assert out[None].n_turns == 1 and (out[2].n_turns, out[2].loss_chars) == (2, 2)


def test_roles_come_back(spark):
    r = random.Random(1)
    roles = ["".join(r.choices("\\n\n\x00\x01<|x", k=r.randint(0, 9))) for _ in range(300)]
    df = spark.createDataFrame([(x,) for x in roles], "role string")
    assert [a.b for a in df.select(chat.unescape_role(chat.escape_role(df["role"])).alias("b")).collect()] == roles


def base_spans(text):
    """The base kinds by Python's re, in order."""
    found = [(m.start(), 0, m.end()) for m in re.finditer(r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text) if len(m[2]) >= 12]
    found += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    found += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 16]
    return [(("assign", "access", "hex")[k], a, b) for a, k, b in sorted(found)]


def test_op9(spark, tables):
    rows, out = {d: t for d, t, *_ in tables[0]}, run(spark, tables, "op9_secret_ownership")
    assert len(out) == len(tables[0])
    for r in out:
        want = base_spans(rows[r.doc_id] or "")
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(k == n for n, _, _ in want) for k in ("assign", "access", "hex"))
        assert r.base_sha256 == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in want).encode()).hexdigest()
        assert set(f"{k}:{a}:{b}" for k, a, b in want) <= set(r.spans.split(",")) or not want


def test_random_spans_are_those_of_re(spark, docs):
    r = random.Random(8)
    bits = ["password", "PassWD", "api_key", "token", "'", '"', " ", ":", "=", "é😀", "AKIA", "QW12ER34", "0a1b2c3d", "ffff", "\n", "_", "secret"]
    rows = [(k, "".join(r.choices(bits, k=r.randint(0, 60)))) for k in range(300)] + [(300, "0123456789abcdef " * 500)]
    out = {x.doc_id: x for x in secrets.report(docs(rows)).collect()}
    for k, text in rows:
        assert out[k].base_sha256 == hashlib.sha256(",".join(f"{n}:{a}:{b}" for n, a, b in base_spans(text)).encode()).hexdigest()


def test_op10(spark, tables, bpe):
    from tokenizers import Tokenizer

    tokenizer, rows = Tokenizer.from_file(bpe), tables[0]
    out = run(spark, tables, "op10_best_fit_packing")
    texts = {d: t for d, t, *_ in rows}
    taken: dict[int, list[tuple[int, int]]] = {}
    pieces: dict[int, set] = {}
    for r in out:
        pieces.setdefault(r.doc_id, set()).add((r.piece, r.start, r.length, r.ids_crc32))
        taken.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert set(pieces) == set(texts)
    for d, found in pieces.items():
        ids = [*tokenizer.encode(texts[d] or "", add_special_tokens=False).ids, 2]
        at = 0
        for k, (piece, start, length, crc) in enumerate(sorted(found)):
            assert (piece, start) == (k, at) and length <= 1024 and crc == zlib.crc32(np.array(ids[at : at + length], "<u4").tobytes())
            at += length
        assert at == len(ids)
    for spans in taken.values():
        assert sum(n for _, n in spans) <= 1024 and [a for a, _ in sorted(spans)] == [0, *np.cumsum([n for _, n in sorted(spans)])[:-1]]


def test_hidden_and_quoted_markup():
    for page, want in [("<p title=it's>one</p><p>it's two</p>", ["one", "it's two"]), ('<p title="a>b">c', ["c"]), ("<p data-x='>' class=a>d</p>", ["d"]), ("<a href=x?a=\"b\">e</a>", ["e"]), ("<p x = \"it's\">f</p><p>g", ["f", "g"])]:
        assert html.parse(page).texts == want


def test_a_long_page_among_short_ones():
    pages = ["<article>" + "<p>some words</p>" * 30_000 + "</article>", *["<article><p>short</p></article>"] * 50]
    texts = html.main_texts(pages, html.trained())
    assert texts[0].count("\n") == 29_999 and texts[1:] == ["short"] * 50
