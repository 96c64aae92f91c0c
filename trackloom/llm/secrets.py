"""Secrets in text, judged by how many repositories and owners a candidate occurs in; DataFrame functions only.

scan() finds candidate spans of every kind in whole texts, with code-point positions, by splitting a text at the matches
of a pattern: the lengths of the pieces and of the matches add up to positions. judge() counts, over the corpus, the
distinct repositories and owners of each candidate value (by its SHA-256): a value of many owners, or of many
repositories however few their owners, is a copied example; one of few of both that isn't a placeholder looks live. redact() writes a mark over live values.

Nulls: a null text is an empty one; all null owners are one owner, and all null repositories one repository. Repeated rows are rows of their
own and don't add owners or repositories. Spans are ordered by start, then kind as in KINDS. An empty table gives an
empty result. Extra columns are kept by redact() and not read otherwise; names of working columns start with `_secret`.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackloom.llm.state import cut


@dataclass(frozen=True)
class Kind:
    name: str
    pattern: str
    #: A text without a match of this has no match of pattern.
    quick: str
    #: The group that is the value, and its least length.
    group: int = 0
    least: int = 0


#: The kinds that any scan has, in the order of ties. For access and hex the least length is in the
#: pattern: their runs end where no further character fits, so a run that is too short holds no other match.
BASE = (
    Kind("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", r"(?i)(?:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]", 2, 12),
    Kind("access", r"AKIA[A-Z0-9]{14,}", r"AKIA[A-Z0-9]{14}"),
    Kind("hex", r"[0-9a-f]{16,}", r"[0-9a-f]{16}"),
)
#: Kinds added to them: tokens with a provider's prefix, signed web tokens, and private keys.
ADDED = (
    Kind("prefixed", r"\b(?:gh[pousr]_|xox[abprs]-|sk_live_|sk-|AIza)[A-Za-z0-9_-]{16,}", r"gh[pousr]_|xox[abprs]-|sk_live_|sk-|AIza"),
    Kind("signed", r"\beyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", r"eyJ"),
    Kind("private", r"-----BEGIN [A-Z ]*PRIVATE KEY-----[A-Za-z0-9+/=\s]+-----END [A-Z ]*PRIVATE KEY-----", r"PRIVATE KEY-----"),
)
KINDS = (*BASE, *ADDED)
SPAN = "struct<start:bigint,kind_no:int,end:bigint,from:bigint,hash:string,filler:boolean>"
#: Values that stand for a secret: words of placeholders, or one character again and again.
FILLER = r"(?i)example|sample|dummy|changeme|placeholder|your_|xxxx|0123456789abcdef|^(.)\1+$"
MARK = "<secret>"
#: Most owners and most repositories of a value that looks live.
OWNERS, REPOSITORIES = 3, 10


#: Matches whose positions are added up at once.
STRIDE = 64


def _let(value: Column, use) -> Column:
    """use(value) with value computed once, however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _placed(rows: Column) -> Column:
    """Start, end and value of matches (gap before it, size, v), by running sums: first the totals of strides of STRIDE
    matches, then within each, so that a text of many matches costs about its matches times STRIDE."""
    none = F.array().cast("array<struct<start:bigint,end:bigint,v:string>>")
    total = lambda part: F.aggregate(part, F.lit(0).cast("bigint"), lambda s, x: s + x["gap"] + x["size"])
    strides = F.filter(F.transform(F.sequence(F.lit(0), F.floor((F.size(rows) / STRIDE)).cast("int")), lambda k: F.slice(rows, k * STRIDE + 1, F.lit(STRIDE))), lambda x: F.size(x) > 0)

    def step(done: Column, x: Column) -> Column:
        start = done["at"] + x["gap"]
        end = start + x["size"]
        return F.struct(end.alias("at"), F.concat(done["out"], F.array(F.struct(start.alias("start"), end.alias("end"), x["v"].alias("v")))).alias("out"))

    within = lambda part, base: F.aggregate(part, F.struct(base.alias("at"), none.alias("out")), step, lambda done: done["out"])
    before = lambda totals: F.transform(totals, lambda t, k: F.aggregate(F.slice(totals, F.lit(1), k), F.lit(0).cast("bigint"), lambda a, x: a + x))
    return _let(strides, lambda parts: _let(F.transform(parts, total), lambda totals: F.flatten(F.zip_with(parts, before(totals), within))))


def spans(text: Column, kind: Kind, number: int) -> Column:
    """Spans of one kind: start and end of the match, start of its value (it ends with the match), hash of the value."""
    whole = F.regexp_extract_all(text, F.lit(kind.pattern), 0)
    pieces, long = F.split(text, kind.pattern, -1), lambda x: F.length(x).cast("bigint")
    if kind.group:
        value = F.regexp_extract_all(text, F.lit(kind.pattern), kind.group)
        matches = F.zip_with(whole, value, lambda m, v: F.struct(long(m).alias("size"), v.alias("v")))
    else:
        matches = F.transform(whole, lambda m: F.struct(long(m).alias("size"), m.alias("v")))
    row = F.filter(F.zip_with(pieces, matches, lambda p, x: F.struct(long(p).alias("gap"), x["size"].alias("size"), x["v"].alias("v"))), lambda x: x["v"].isNotNull())
    found = _let(row, _placed)
    if kind.least:
        found = F.filter(found, lambda x: F.length(x["v"]) >= kind.least)
    made = F.transform(found, lambda x: F.struct(x["start"].alias("start"), F.lit(number).alias("kind_no"), x["end"].alias("end"), (x["end"] - F.length(x["v"])).cast("bigint").alias("from"), F.sha2(x["v"].cast("binary"), 256).alias("hash"), x["v"].rlike(FILLER).alias("filler")).cast(SPAN))
    return F.when(text.rlike(kind.quick), made).otherwise(F.array().cast(f"array<{SPAN}>"))


def candidates(text: Column) -> Column:
    """All spans of a text, by start and then kind."""
    text = F.coalesce(text.cast("string"), F.lit(""))
    return F.array_sort(F.concat(*(spans(text, kind, k) for k, kind in enumerate(KINDS))))


def scan(docs: DataFrame, owner: str, repository: str, keep: list[str]) -> DataFrame:
    """Columns keep, and _secret_row, _secret_owner, _secret_repository, _secret_spans of every row."""
    return cut(
        docs.select(
            *keep,
            F.monotonically_increasing_id().alias("_secret_row"),
            F.coalesce(F.col(owner).cast("string"), F.lit("")).alias("_secret_owner"),
            F.coalesce(F.col(repository).cast("string"), F.lit("")).alias("_secret_repository"),
            candidates(F.col("text")).alias("_secret_spans"),
        ),
        "secret-spans",
    )


def judge(scanned: DataFrame, owners: int = OWNERS, repositories: int = REPOSITORIES) -> DataFrame:
    """_secret_row and its spans with `live`: the value has at most so many owners and repositories and is no placeholder."""
    rows = scanned.where(F.size("_secret_spans") > 0).select("_secret_row", "_secret_owner", "_secret_repository", F.explode("_secret_spans").alias("span"))
    counted = rows.groupBy(F.col("span.hash").alias("hash")).agg(F.count_distinct("_secret_owner").alias("n_owners"), F.count_distinct("_secret_repository").alias("n_repositories"))
    counted = cut(counted, "secret-counts")
    live = (F.col("n_owners") <= owners) & (F.col("n_repositories") <= repositories) & ~F.col("span.filler")
    judged = rows.join(counted, rows["span"]["hash"] == counted["hash"])
    return judged.groupBy("_secret_row").agg(F.array_sort(F.collect_list(F.struct(F.col("span.start").alias("start"), F.col("span.kind_no").alias("kind_no"), F.col("span.end").alias("end"), F.col("span.from").alias("from"), live.alias("live"), "n_owners", "n_repositories"))).alias("spans"))


def shown(spans: Column) -> Column:
    """kind:start:end of spans, joined by commas."""
    names = F.array(*(F.lit(k.name) for k in KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind_no"]), s["start"], s["end"])), ",")


def report(docs: DataFrame, owner: str = "source", repository: str = "doc_id") -> DataFrame:
    """Per row: counts and digest of the base kinds, all spans, and how many of them are live or copied examples."""
    scanned = scan(docs, owner, repository, ["doc_id"])
    base = F.filter("_secret_spans", lambda s: s["kind_no"] < len(BASE))
    number = lambda k: F.size(F.filter("_secret_spans", lambda s: s["kind_no"] == k)).cast("bigint")
    judged = judge(scanned).select(F.col("_secret_row").alias("_judged_row"), "spans")
    out = scanned.join(judged, F.col("_secret_row") == F.col("_judged_row"), "left")
    live = F.filter("spans", lambda s: s["live"])
    return out.select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        *(number(k).alias(f"n_{kind.name}") for k, kind in enumerate(BASE)),
        F.sha2(shown(base).cast("binary"), 256).alias("base_sha256"),
        shown(F.col("_secret_spans")).alias("spans"),
        F.coalesce(F.size(live), F.lit(0)).cast("bigint").alias("n_live"),
        F.coalesce(F.size(F.filter("spans", lambda s: ~s["live"])), F.lit(0)).cast("bigint").alias("n_example"),
        F.coalesce(shown(live), F.lit("")).alias("live_spans"),
        F.coalesce(F.array_max(F.transform("spans", lambda s: s["n_owners"])), F.lit(0)).alias("most_owners"),
    )


def redact(docs: DataFrame, owner: str = "source", repository: str = "doc_id", owners: int = OWNERS, repositories: int = REPOSITORIES) -> DataFrame:
    """docs with MARK in place of every live value; n_chars, where docs has it, follows the text."""
    suspect = F.lit(False)
    for kind in KINDS:
        suspect = suspect | F.coalesce(F.col("text").rlike(kind.quick), F.lit(False))
    some = scan(docs.where(suspect), owner, repository, docs.columns)
    judged = judge(some, owners, repositories).select(F.col("_secret_row").alias("_judged_row"), F.filter("spans", lambda s: s["live"]).alias("_secret_live"))
    joined = some.join(judged, F.col("_secret_row") == F.col("_judged_row"), "left")

    def step(done: Column, s: Column) -> Column:
        """Text from the end of the last mark to this value, and the mark; a value inside one that is gone is skipped."""
        inside = s["end"] <= done["at"]
        start = F.greatest(s["from"], done["at"])
        gap = F.substr("text", (done["at"] + 1).cast("int"), (start - done["at"]).cast("int"))
        return F.struct(F.greatest(done["at"], s["end"]).alias("at"), F.when(inside, done["out"]).otherwise(F.concat(done["out"], gap, F.when(s["from"] < done["at"], "").otherwise(MARK))).alias("out"))

    by_value = F.array_sort(F.transform("_secret_live", lambda s: F.struct(s["from"].alias("from"), s["end"].alias("end"))))
    marked = F.aggregate(by_value, F.struct(F.lit(0).cast("bigint").alias("at"), F.lit("").alias("out")), step, lambda done: F.concat(done["out"], F.substr("text", (done["at"] + 1).cast("int"))))
    new = joined.withColumn("text", F.when(F.size("_secret_live") > 0, marked).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        new = new.withColumn("n_chars", F.when(F.size("_secret_live") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return docs.where(~suspect).unionByName(new.select(*docs.columns))
