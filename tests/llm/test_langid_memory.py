"""Language identification in an executor's worker: memory doesn't follow the batch, and results don't follow the slabs."""

from __future__ import annotations

import random
import tracemalloc

import pyarrow as pa
import pytest

from trackloom.llm import langid

LETTERS = {"x": "abcdefgh", "y": "hijklmnoé"}


def _batch(rows: int, words: int) -> pa.RecordBatch:
    rng = random.Random(5)
    vocabulary = {k: ["".join(rng.choices(v, k=rng.randint(2, 8))) for _ in range(400)] for k, v in LETTERS.items()}
    langs = [rng.choice("xy") for _ in range(rows)]
    texts = [" ".join(rng.choices(vocabulary[k], k=words)) for k in langs]
    texts[3], texts[7], texts[11] = None, "", "123 456"
    return pa.record_batch([pa.array(langs), pa.array(texts, pa.string())], names=["lang", "text"])


def _counts(batches) -> dict[tuple[str, int], int]:
    out: dict[tuple[str, int], int] = {}
    for b in langid._learn(iter(batches)):
        for lang, gram, n in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True):
            out[lang, gram] = out.get((lang, gram), 0) + n
    return out


def _profiles(counts) -> dict[str, list[int]]:
    return {k: [g for _, g in sorted((-n, g) for (lang, g), n in counts.items() if lang == k)[: langid.TOP]] for k in LETTERS}


def _classified(batches, profiles) -> list[dict]:
    return [r for b in langid._classify(iter(batches), profiles, "text") for r in b.to_pylist()]


@pytest.mark.parametrize("step", ["learn", "classify"])
def test_memory_of_a_worker(step):
    batch = _batch(4000, 200)
    assert batch.column("text").nbytes > 4e6
    profiles = _profiles(_counts([_batch(200, 50)]))
    tracemalloc.start()
    try:
        rows = 0
        for b in langid._learn(iter([batch])) if step == "learn" else langid._classify(iter([batch]), profiles, "text"):
            rows += b.num_rows
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert rows == batch.num_rows or step == "learn" and rows
    assert peak < 50e6


def test_slabs_change_no_result(monkeypatch):
    batch = _batch(600, 60)
    counts = _counts([batch])
    found = _classified([batch], _profiles(counts))
    assert [r["text"] for r in found] == batch.column("text").to_pylist() and {r["lang_pred"] for r in found} == {"x", "y", "und"}
    for size in (1, 1000, 1 << 20):
        monkeypatch.setattr(langid, "SLAB", size)
        assert _counts([batch.slice(0, 250), batch.slice(250)]) == counts
        assert _classified([batch.slice(0, 250), batch.slice(250, 0), batch.slice(250)], _profiles(counts)) == found
