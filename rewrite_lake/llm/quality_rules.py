"""Quality rules as a bitmask ledger (DataFrame functions only).

Every rule is evaluated once per document: its measurement and its failure bit
are stored in a ledger.  Policies are versioned masks over those bits, so a new
policy, or what a rule is worth (:func:`ablations`), needs the ledger alone,
never the texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, let, read, words

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper")

#: Rule name -> failure condition over the measurements; bit = place in the list.
RULES = [
    ("few_words", "n_words < 50"),
    ("repeated_words", "100 * n_repeat_words > 50 * n_words"),
    ("symbols", "100 * n_symbols > 25 * n_words"),
    ("dup_lines", "100 * n_dup_lines > 50 * n_lines"),
    ("word_length", "word_chars < 2 * n_words or word_chars > 15 * n_words"),
    ("shouting", "100 * n_upper > 50 * word_chars"),
]
BIT = {name: 1 << i for i, (name, _) in enumerate(RULES)}
#: Policy version -> mask of the rules that reject a document.
POLICIES = {"v1": BIT["few_words"] | BIT["repeated_words"], "v2": (1 << len(RULES)) - 1}
BASE = POLICIES["v1"]


def _repeated(w: Column) -> Column:
    """Words inside three-word windows that occur at least twice.

    Windows are compared by 64-bit hash.  Documents whose hashes are all
    different (nearly all) end there; in the others (hash, position) pairs are
    sorted, windows equal to a neighbour are repeats, and the positions they
    cover are counted once each: O(n log n) for any text.
    """
    def covered(h):
        order = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        def positions(s):
            twice = F.filter(s, lambda x, k: (x["h"] == F.get(s, k - 1)["h"]) | (x["h"] == F.get(s, k + 1)["h"]))
            at = F.transform(twice, lambda x: x["i"])
            return F.size(F.array_distinct(F.flatten(F.transform(at, lambda i: F.array(i, i + 1, i + 2)))))
        return let(order, positions)
    hashes = F.transform(F.sequence(F.lit(0), F.size(w) - 3),
                         lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))
    count = let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(covered(h)))
    return F.when(F.size(w) < 4, F.lit(0)).otherwise(count)


def measure(text: Column) -> Column:
    """Struct of all measurements of a text (null: as the empty text)."""
    text = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))

    def body(w):
        return F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.char_length(F.array_join(w, "")).cast("long").alias("word_chars"),
            _repeated(w).cast("long").alias("n_repeat_words"))
    by_line = let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n_lines"),
                                            (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines")))
    return F.struct(let(words(text), body).alias("w"), by_line.alias("l"),
                    F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
                    F.regexp_count(text, F.lit(r"\p{Lu}")).cast("long").alias("n_upper"))


def ledger(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` without its text, plus the measurements and ``fail_bits``.

    Null, empty and blank texts have zero measurements and fail ``few_words``.
    Repeated rows are measured each; an empty table gives an empty ledger.
    Ledger columns whose names clash with columns of ``docs`` replace them.
    """
    keep = [c for c in docs.columns if c != text_col and c.lower() not in {*MEASURES, "fail_bits"}]
    (m,) = fresh(docs, "m")
    out = docs.select(*[F.col(f"`{c}`") for c in keep], measure(F.col(text_col)).alias(m))
    places = {"n_words": "w", "word_chars": "w", "n_repeat_words": "w", "n_lines": "l", "n_dup_lines": "l"}
    cols = [(F.col(m)[places[c]][c] if c in places else F.col(m)[c]).alias(c) for c in MEASURES]
    out = out.select(*[F.col(f"`{c}`") for c in keep], *cols)
    bits = sum((F.when(F.expr(cond), F.lit(BIT[name])).otherwise(F.lit(0)) for name, cond in RULES), F.lit(0))
    return out.withColumn("fail_bits", bits.cast("long"))


def passes(bits: Column, policy: str = "v2") -> Column:
    """Whether a document passes a policy: none of its rules' bits is set."""
    return bits.bitwiseAND(F.lit(POLICIES[policy])) == 0


def ablations(book: DataFrame, policy: str = "v2") -> DataFrame:
    """Per rule of a policy: documents that fail it, that fail it alone, and how
    many the policy would keep without it.  The ledger is first summed up per
    bit pattern (at most 2**rules rows)."""
    mask = POLICIES[policy]
    patterns = book.groupBy(F.col("fail_bits").bitwiseAND(F.lit(mask)).alias("bits")).agg(F.count(F.lit(1)).alias("n"))
    rules = F.explode(F.array(*[F.struct(F.lit(name).alias("rule"), F.lit(BIT[name]).alias("bit"))
                                for name, _ in RULES if BIT[name] & mask]))
    each = patterns.select("bits", "n", rules.alias("r"))
    hit = F.col("bits").bitwiseAND(F.col("r.bit")) != 0
    without = F.col("bits").bitwiseAND(F.bitwise_not(F.col("r.bit"))) == 0
    return each.groupBy(F.col("r.rule").alias("rule")).agg(
        F.sum(F.when(hit, F.col("n")).otherwise(0)).alias("failed"),
        F.sum(F.when(F.col("bits") == F.col("r.bit"), F.col("n")).otherwise(0)).alias("failed_alone"),
        F.sum(F.when(without, F.col("n")).otherwise(0)).alias("kept_without"))


def filter_documents(docs: DataFrame, text_col: str = "text", policy: str = "v2") -> DataFrame:
    """The rows of ``docs`` that pass a policy, columns unchanged."""
    (bits,) = fresh(docs, "fail_bits")
    (m,) = fresh(docs, "m")
    measured = docs.withColumn(m, measure(F.col(text_col)))
    places = {"n_words": "w", "word_chars": "w", "n_repeat_words": "w", "n_lines": "l", "n_dup_lines": "l"}
    fails = F.lit(0)
    for name, cond in RULES:
        for c in MEASURES:
            cond = cond.replace(c, f"{m}.{places[c]}.{c}" if c in places else f"{m}.{c}")
        fails = fails + F.when(F.expr(cond), F.lit(BIT[name])).otherwise(F.lit(0))
    return measured.where(passes(fails.cast("long"), policy)).drop(m)


def op2_quality_rules(spark, sf_dir):
    book = ledger(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return book.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                       (~passes(F.col("fail_bits"), "v1")).alias("base_failed"),
                       passes(F.col("fail_bits"), "v2").alias("kept"),
                       "n_lines", "n_upper", "fail_bits")


QUERIES = {"op2_quality_rules": op2_quality_rules}

ORACLE = {"op2_quality_rules": r"""
with t as (select row_number() over () as rid, doc_id, coalesce(text, '') as text from documents),
w as (select rid, doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') as w,
             [x for x in string_split(text, chr(10)) if regexp_matches(x, '[^\x20\x09-\x0D]')] as l from t),
grams as (
  select rid, unnest(range(1, len(w) - 1)) as i,
         unnest([[w[i], w[i + 1], w[i + 2]] for i in range(1, len(w) - 1)]) as g
  from w where len(w) >= 3),
twice as (select rid, i from (select *, count(*) over (partition by rid, g) as c from grams) where c > 1),
cover as (select rid, count(distinct p) as n from (select rid, unnest([i, i + 1, i + 2]) as p from twice) group by rid),
m as (
  select w.doc_id, len(w)::bigint as n_words, length(array_to_string(w, ''))::bigint as word_chars,
         len(regexp_extract_all(text, '[#*$%&|<>]'))::bigint as n_symbols,
         (len(l) - len(list_distinct(l)))::bigint as n_dup_lines,
         coalesce(cover.n, 0)::bigint as n_repeat_words, len(l)::bigint as n_lines,
         len(regexp_extract_all(text, '\p{Lu}'))::bigint as n_upper
  from w left join cover using (rid)),
b as (
  select *, ((n_words < 50)::int + 2 * (100 * n_repeat_words > 50 * n_words)::int
         + 4 * (100 * n_symbols > 25 * n_words)::int + 8 * (100 * n_dup_lines > 50 * n_lines)::int
         + 16 * (word_chars < 2 * n_words or word_chars > 15 * n_words)::int
         + 32 * (100 * n_upper > 50 * word_chars)::int)::bigint as fail_bits from m)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       (fail_bits & 3) <> 0 as base_failed, fail_bits = 0 as kept, n_lines, n_upper, fail_bits from b
"""}
