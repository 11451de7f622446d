"""Secret scans with corpus-wide ownership frequency (DataFrame functions only).

Candidates are found by pattern in every whole text, with code point offsets.
Each candidate's value is hashed, and hashes are counted over distinct
repositories and owners: a value that several owners carry is a copied example,
a value without variety is a placeholder, and what one or two owners hold and
looks random is taken for a live credential.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, materialize, read, running_sum

#: kind, pattern, group of the value, least length of the value.  The first
#: three are the base kinds; the others are added by this operator.  Runs are taken
#: whole and never entered in their middle, so a text is read in linear time.
KINDS = [
    ("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    ("access", r"AKIA[A-Z0-9]+", 0, 18),
    ("hex", r"[0-9a-f]{16,}", 0, 16),
    ("github", r"gh[pousr]_[A-Za-z0-9]{36,}", 0, 40),
    ("jwt", r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{10,}+\.[A-Za-z0-9_-]{10,}+\.[A-Za-z0-9_-]{10,}+", 0, 35),
    ("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----[A-Za-z0-9+/=\s]{40,}+-----END [A-Z ]*PRIVATE KEY-----", 0, 90),
]
N_BASE = 3
#: A value held by at least so many distinct owners is a copied example.
MIN_OWNERS = 3
#: A value with fewer distinct characters is a placeholder.
MIN_DISTINCT = 6
MASK = "<SECRET>"

_SPAN = "array<struct<start:bigint,k:int,end:bigint,hash:string,plain:boolean>>"


def _spans_of(text: Column, k: int) -> Column:
    """Matches of one kind: the texts between matches and the matches themselves
    alternate, so running sums of their lengths are the offsets."""
    _, pattern, group, least = KINDS[k]
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    gaps = F.split(text, pattern, -1)

    def place(x):
        steps = F.transform(x["found"], lambda m, i: (F.char_length(m) + F.char_length(F.get(x["gaps"], i))).cast("long"))
        ends = let(steps, running_sum)
        spans = F.transform(x["found"], lambda m, i: F.struct(
            F.char_length(m).cast("long").alias("n"), F.get(x["values"], i).alias("v"), i.alias("i")))
        long_enough = lambda e: F.filter(spans, lambda s: F.char_length(s["v"]) >= least)
        return let(ends, lambda e: F.transform(long_enough(e), lambda s: F.struct(
            (F.get(e, s["i"]) - s["n"]).alias("start"), F.lit(k).alias("k"), F.get(e, s["i"]).alias("end"),
            F.sha2(s["v"], 256).alias("hash"),
            (F.size(F.array_distinct(F.split(F.lower(s["v"]), ""))) < MIN_DISTINCT).alias("plain"))))
    packed = F.struct(found.alias("found"), values.alias("values"), gaps.alias("gaps"))
    return F.when(text.rlike(pattern), let(packed, place)).otherwise(F.array().cast(_SPAN))


def find_spans(text: Column) -> Column:
    """All spans of a text (null: none), ordered by start, then kind as listed."""
    text = F.coalesce(text, F.lit(""))
    return F.sort_array(F.concat(*[_spans_of(text, k) for k in range(len(KINDS))]))


def join_spans(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    names = F.array(*[F.lit(name) for name, *_ in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["k"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def ownership(found: DataFrame, min_owners: int = MIN_OWNERS) -> DataFrame:
    """(hash, plain, repo, owner) rows -> one row per hash: n_repos, n_owners, class.

    Counted in steps (distinct triples, then owners, then hashes), each summed
    up before its shuffle, so a secret that a third of all rows carry is no hot
    group.  Null repositories or owners count as one of their kind.
    """
    triples = found.groupBy("hash", "owner", "repo").agg(F.max("plain").alias("plain"))
    repos = triples.groupBy("hash", "repo").agg(F.max("plain").alias("plain"))
    repos = repos.groupBy("hash").agg(F.count(F.lit(1)).alias("n_repos"), F.max("plain").alias("plain"))
    owners = triples.groupBy("hash", "owner").agg(F.lit(1).alias("one")).groupBy("hash").agg(F.count(F.lit(1)).alias("n_owners"))
    kind = (F.when(F.col("n_owners") >= min_owners, F.lit("example"))
            .when(F.col("plain"), F.lit("placeholder")).otherwise(F.lit("live")))
    return repos.join(owners, "hash").select("hash", "n_repos", "n_owners", kind.alias("class"))


def _verdicts(book: DataFrame, min_owners: int) -> DataFrame:
    """(t, owner, repo, spans) rows -> per text key t: its spans with their class."""
    each = book.where(F.size("spans") > 0)
    found = each.select("owner", "repo", F.explode("spans").alias("s")).select(
        "owner", "repo", F.col("s.hash").alias("hash"), F.col("s.plain").alias("plain"))
    stats = ownership(found, min_owners)
    texts = each.select("t", F.explode("spans").alias("s")).groupBy("t", "s.k", "s.start", "s.end", "s.hash").agg(F.lit(1).alias("one"))
    joined = texts.join(stats, "hash")
    return joined.groupBy("t").agg(
        F.sort_array(F.collect_list(F.struct("start", "end", "class"))).alias("verdicts"),
        *[F.sum((F.col("class") == c).cast("long")).alias(f"n_{c}") for c in ("live", "example", "placeholder")])


def scan(docs: DataFrame, *, text_col: str = "text", owner_col: str = "source", repo_col: str = "doc_id",
         keep=("doc_id",), min_owners: int = MIN_OWNERS) -> DataFrame:
    """The columns ``keep``, spans, and how many are live, example, placeholder.

    A null text is the empty text and has no spans.  Equal texts share their
    spans' classes; repeated rows count once per repository and owner.  An empty
    table gives no rows.  Columns of ``docs`` beyond those named are ignored.
    """
    text = F.col(text_col)
    kept = [F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(keep)]
    book = materialize(docs.select(
        *kept, F.col(owner_col).cast("string").alias("owner"), F.col(repo_col).cast("string").alias("repo"),
        find_spans(text).alias("spans"), F.sha2(F.coalesce(text, F.lit("")), 256).alias("t")), "secrets")
    counts = ["n_live", "n_example", "n_placeholder"]
    back = [F.col(f"k{i}").alias(c) for i, c in enumerate(keep)]
    hit = book.where(F.size("spans") > 0).join(_verdicts(book, min_owners), "t")
    none = book.where(F.size("spans") == 0)
    return hit.select(*back, "spans", *counts).union(
        none.select(*back, "spans", *[F.lit(0).cast("long").alias(c) for c in counts]))


def redact(docs: DataFrame, *, text_col: str = "text", owner_col: str = "source", repo_col: str = "doc_id",
           min_owners: int = MIN_OWNERS, mask: str = MASK) -> DataFrame:
    """``docs`` with every live credential's span replaced by ``mask``.

    Rows without a candidate pass through untouched and unshuffled; all rows
    stay.  Null texts stay null.
    """
    text = F.col(text_col)
    names = docs.columns
    any_kind = F.lit(False)
    for _, pattern, _, _ in KINDS:
        any_kind = any_kind | F.coalesce(text, F.lit("")).rlike(pattern)
    hit = docs.where(any_kind)
    packed = hit.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), F.sha2(text, 256).alias("t"),
                        F.col(owner_col).cast("string").alias("owner"), F.col(repo_col).cast("string").alias("repo"),
                        find_spans(text).alias("spans"))
    book = materialize(packed, "redact")
    live = _verdicts(book, min_owners).select("t", F.filter("verdicts", lambda v: v["class"] == "live").alias("live"))
    joined = book.join(live, "t", "left")
    body = F.col("row")[text_col]
    # overlapping spans merge: a span inside or touching the reach of those before it is theirs
    merged = F.aggregate(
        F.coalesce("live", F.array().cast("array<struct<start:bigint,end:bigint,class:string>>")),
        F.struct(F.lit("").alias("out"), F.lit(0).cast("long").alias("at")),
        lambda acc, s: F.struct(
            F.when(s["start"] >= acc["at"], F.concat(
                acc["out"], F.substr(body, (acc["at"] + 1).cast("int"), (s["start"] - acc["at"]).cast("int")), F.lit(mask)))
            .otherwise(acc["out"]).alias("out"),
            F.greatest(acc["at"], s["end"]).alias("at")),
        lambda acc: F.concat(acc["out"], F.substr(body, (acc["at"] + 1).cast("int"), F.char_length(body) + 1)))
    cleaned = joined.select(*[(merged.alias(c) if c == text_col else F.col("row")[c].alias(c)) for c in names])
    return docs.where(~any_kind).unionByName(cleaned) if len({c.lower() for c in names}) == len(names) else docs.where(~any_kind).union(cleaned)


def op3_secret_scan(spark, sf_dir):
    out = scan(read(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    base = F.filter("spans", lambda s: s["k"] < N_BASE)
    count = lambda k: F.size(F.filter("spans", lambda s: s["k"] == k)).cast("long")
    return out.select("doc_id", *[count(k).alias(f"n_{KINDS[k][0]}") for k in range(N_BASE)],
                      F.sha2(join_spans(base), 256).alias("base_sha256"), join_spans(F.col("spans")).alias("spans"),
                      "n_live", "n_example", "n_placeholder")


QUERIES = {"op3_secret_scan": op3_secret_scan}
ORACLE: dict[str, str] = {}
