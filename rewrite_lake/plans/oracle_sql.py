"""SQL building blocks for the DuckDB oracle (``__spark_entry__.oracle_sql``).

The oracle is an independent restatement of each query in plain ANSI/DuckDB
SQL over the driver tables.  These helpers render the fixture views and the
text rules as SQL text; the Spark side never uses them.
"""

from __future__ import annotations

LEXICON_ALT = "idiot|moron|stupid|loser|trash|scum|clown|worthless|pathetic|disgusting"
LEX_RE = r"\b(" + LEXICON_ALT + r")\b"

PAIRS_WIDE = """
pairs_wide as (
  select conv_id, turn, text as toxic, n1 as neutral1,
         case when pair_no % 3 <> 0 then n2 end as neutral2, n3 as neutral3
  from (select conv_id, turn, role, text, conv_id + turn as pair_no,
               lead(text,1) over w as n1, lead(text,3) over w as n2, lead(text,5) over w as n3
        from conversations window w as (partition by conv_id order by turn, text)) t
  where role = 'user')"""

LINE_SAMPLES = """
line_samples as (
  select d.doc_id, cast(i as integer) as line_no, string_split(d.text, chr(10))[i + 1] as source
  from documents d, unnest(range(0, len(string_split(d.text, chr(10))))) as r(i))"""

RUNS = """
runs as (
  select d.source as model, d.lang as variant, avg(cast(1 - l.toxic as double)) as STA,
         avg(cast(l.quality as double)) as FL, count(*) as n
  from documents d join labels l on d.doc_id = l.doc_id group by d.source, d.lang)"""

VEC_PAIRS = """
vec_pairs as (
  select a.vec_id, a.embedding as va, b.embedding as vb, a.label as la, b.label as lb
  from embeddings a join embeddings b on b.vec_id = a.vec_id + 1)"""


def strip(expr: str) -> str:
    """Python ``strip()`` on ASCII-whitespace data."""
    return f"regexp_replace({expr}, '^\\s+|\\s+$', '', 'g')"


def split_ws(expr: str) -> str:
    return f"list_filter(regexp_split_to_array({expr}, '\\s+'), lambda t: t <> '')"


def drop_lex(expr: str) -> str:
    return f"regexp_replace({expr}, '{LEX_RE}', '', 'gi')"


def mask_lex(expr: str) -> str:
    return f"regexp_replace({expr}, '{LEX_RE}', '***', 'gi')"


def lex_hits(expr: str) -> str:
    return f"len(regexp_extract_all(lower({expr}), '{LEX_RE}'))"


def reference(expr: str) -> str:
    return f"regexp_replace({drop_lex(expr)}, ' +', ' ', 'g')"


def tok13a(expr: str) -> str:
    """13a tokens as a DuckDB list expression."""
    s = f"regexp_replace({expr}, '\\s+$', '')"
    s = f"replace({s}, '<skipped>', '')"
    s = f"replace({s}, '-' || chr(10), '')"
    s = f"replace({s}, chr(10), ' ')"
    for a, b in (("&quot;", '"'), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">")):
        s = f"replace({s}, '{a}', '{b}')"
    s = f"(' ' || {s} || ' ')"
    s = f"regexp_replace({s}, '([\\{{-\\~\\[-\\` -\\&\\(-\\+\\:-\\@\\/])', ' \\1 ', 'g')"
    s = f"regexp_replace({s}, '([^0-9])([\\.,])', '\\1 \\2 ', 'g')"
    s = f"regexp_replace({s}, '([\\.,])([^0-9])', ' \\1 \\2', 'g')"
    s = f"regexp_replace({s}, '([0-9])(-)', '\\1 \\2 ', 'g')"
    return split_ws(s)


def bleu_stats_ctes(src: str, id_cols: str, hyp: str, ref: str, prefix: str = "b") -> str:
    """CTEs computing per-row BLEU statistics ``{prefix}_stats`` from ``src``.

    ``id_cols`` is a comma list of key columns of ``src``; output has the keys
    plus c1..c4, t1..t4, hyp_len, ref_len.
    """
    p = prefix
    return f"""
{p}_tok as (select {id_cols}, {tok13a(hyp)} as ht, {tok13a(ref)} as rt from {src}),
{p}_hg as (select {id_cols}, n, array_to_string(ht[i:i+n-1], ' ') as g
           from {p}_tok, unnest([1,2,3,4]) as nn(n), unnest(range(1, len(ht) - n + 2)) as ii(i)),
{p}_rg as (select {id_cols}, n, array_to_string(rt[i:i+n-1], ' ') as g
           from {p}_tok, unnest([1,2,3,4]) as nn(n), unnest(range(1, len(rt) - n + 2)) as ii(i)),
{p}_hc as (select {id_cols}, n, g, count(*) as c from {p}_hg group by all),
{p}_rc as (select {id_cols}, n, g, count(*) as c from {p}_rg group by all),
{p}_m as (select {_qual(id_cols, 'h')}, h.n, least(h.c, r.c) as m
          from {p}_hc h join {p}_rc r on {_on(id_cols)} and h.n = r.n and h.g = r.g),
{p}_ms as (select {id_cols},
                  sum(case when n = 1 then m else 0 end) as c1, sum(case when n = 2 then m else 0 end) as c2,
                  sum(case when n = 3 then m else 0 end) as c3, sum(case when n = 4 then m else 0 end) as c4
           from {p}_m group by all),
{p}_stats as (select {_qual(id_cols, 't')},
                  cast(coalesce(ms.c1, 0) as bigint) as c1, cast(coalesce(ms.c2, 0) as bigint) as c2,
                  cast(coalesce(ms.c3, 0) as bigint) as c3, cast(coalesce(ms.c4, 0) as bigint) as c4,
                  cast(greatest(len(t.ht), 0) as bigint) as t1, cast(greatest(len(t.ht) - 1, 0) as bigint) as t2,
                  cast(greatest(len(t.ht) - 2, 0) as bigint) as t3, cast(greatest(len(t.ht) - 3, 0) as bigint) as t4,
                  cast(len(t.ht) as bigint) as hyp_len, cast(len(t.rt) as bigint) as ref_len
              from {p}_tok t left join {p}_ms ms on {_on(id_cols, 't', 'ms')})"""


def _qual(id_cols: str, alias: str) -> str:
    return ", ".join(f"{alias}.{c.strip()}" for c in id_cols.split(","))


def _on(id_cols: str, a: str = "h", b: str = "r") -> str:
    return " and ".join(f"{a}.{c.strip()} = {b}.{c.strip()}" for c in id_cols.split(","))


def bleu_expr(s: str = "", effective: bool = True) -> str:
    """BLEU (0-100) from statistic columns with prefix ``s`` (e.g. ``'x.'``)."""
    c = [f"cast({s}c{n} as double)" for n in range(1, 5)]
    t = [f"cast({s}t{n} as double)" for n in range(1, 5)]
    terms = []
    zeros = []
    for n in range(4):
        zeros.append(f"(case when {t[n]} > 0 and {c[n]} = 0 then 1 else 0 end)")
        z = " + ".join(zeros)
        p = f"(case when {c[n]} = 0 then 100e0 / (pow(2e0, {z}) * {t[n]}) else 100e0 * {c[n]} / {t[n]} end)"
        terms.append(f"(case when {t[n]} > 0 then ln({p}) else 0e0 end)")
    log_sum = " + ".join(terms)
    reached = " + ".join(f"(case when {t[n]} > 0 then 1 else 0 end)" for n in range(4))
    order = f"({reached})" if effective else "4e0"
    hl, rl = f"cast({s}hyp_len as double)", f"cast({s}ref_len as double)"
    bp = f"(case when {hl} < {rl} then (case when {hl} > 0 then exp(1e0 - {rl} / {hl}) else 0e0 end) else 1e0 end)"
    complete = f"({reached}) > 0" if effective else f"{t[3]} > 0"
    return (f"(case when ({c[0]} + {c[1]} + {c[2]} + {c[3]}) > 0 and {complete} "
            f"then {bp} * exp(({log_sum}) / {order}) else 0e0 end)")


def with_(*ctes: str) -> str:
    return "with " + ",".join(ctes)
