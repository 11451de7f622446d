"""DuckDB oracle SQL, one string per registered query (same names, same columns)."""

from __future__ import annotations

from .oracle_sql import (PAIRS_WIDE, bleu_expr, bleu_stats_ctes, strip, tok13a, with_)

ORACLE: dict[str, str] = {}

PAIRS_LONG = f"""
pairs_long as (
  select * from (
    select conv_id, turn, {strip('toxic')} as input, 1 as target_no, {strip('neutral1')} as target from pairs_wide
    union all select conv_id, turn, {strip('toxic')}, 2, {strip('neutral2')} from pairs_wide
    union all select conv_id, turn, {strip('toxic')}, 3, {strip('neutral3')} from pairs_wide) u
  where length(input) >= 5 and target is not null and length(target) >= 5)"""

ORACLE["prepare_pairs"] = with_(PAIRS_WIDE, PAIRS_LONG) + """
select conv_id, turn, cast(target_no as integer) as target_no, input, target from pairs_long"""

ORACLE["prepare_audit"] = with_(PAIRS_WIDE) + f"""
select cast(count(*) as bigint) as rows_in,
       cast(count(case when length({strip('toxic')}) >= 5 then 1 end) as bigint) as sources_kept,
       cast(coalesce(sum(case when length({strip('toxic')}) >= 5 then
            (case when neutral1 is not null and length({strip('neutral1')}) >= 5 then 1 else 0 end)
          + (case when neutral2 is not null and length({strip('neutral2')}) >= 5 then 1 else 0 end)
          + (case when neutral3 is not null and length({strip('neutral3')}) >= 5 then 1 else 0 end)
          else 0 end), 0) as bigint) as pairs_out
from pairs_wide"""

ORACLE["bleu_tokens"] = f"""
select doc_id, cast(len(tk) as bigint) as n_tokens, md5(array_to_string(tk, ' ')) as tokens_md5
from (select doc_id, {tok13a('text')} as tk from documents) t"""

ORACLE["bleu_stats"] = with_(PAIRS_WIDE, PAIRS_LONG,
                             bleu_stats_ctes("pairs_long", "conv_id, turn, target_no", "input", "target")) + """
select conv_id, turn, cast(target_no as integer) as target_no, c1, c2, c3, c4, t1, t2, t3, t4, hyp_len, ref_len
from b_stats"""

ORACLE["sentence_bleu"] = with_(PAIRS_WIDE, PAIRS_LONG,
                                bleu_stats_ctes("pairs_long", "conv_id, turn, target_no", "input", "target")) + f"""
select conv_id, turn, cast(target_no as integer) as target_no, round({bleu_expr()}, 6) as bleu,
       round({bleu_expr()} / 100e0, 6) as bleu_norm
from b_stats"""

ORACLE["corpus_bleu"] = with_(PAIRS_WIDE, PAIRS_LONG,
                              bleu_stats_ctes("pairs_long", "conv_id, turn, target_no", "input", "target")) + f"""
select cast(target_no as integer) as target_no, n_pairs, c1, c2, c3, c4, t1, t2, t3, t4, hyp_len, ref_len,
       round({bleu_expr(effective=False)}, 6) as bleu
from (select target_no, cast(count(*) as bigint) as n_pairs,
             cast(sum(c1) as bigint) as c1, cast(sum(c2) as bigint) as c2, cast(sum(c3) as bigint) as c3,
             cast(sum(c4) as bigint) as c4, cast(sum(t1) as bigint) as t1, cast(sum(t2) as bigint) as t2,
             cast(sum(t3) as bigint) as t3, cast(sum(t4) as bigint) as t4,
             cast(sum(hyp_len) as bigint) as hyp_len, cast(sum(ref_len) as bigint) as ref_len
      from b_stats group by target_no) s"""


# --- scorers, candidates, rerank -------------------------------------------------

from .oracle_sql import LINE_SAMPLES, drop_lex, lex_hits, mask_lex, reference, split_ws  # noqa: E402

SAMPLES = f"""
samples as (select doc_id, line_no, source, {reference('source')} as reference from line_samples)"""

CANDS = f"""
cands as (
  select doc_id, line_no, source, reference, 0 as model_idx, 'identity' as model, 0 as candidate_rank,
         {strip('source')} as text from samples
  union all select doc_id, line_no, source, reference, 1, 'drop', 0, {strip(drop_lex('source'))} from samples
  union all select doc_id, line_no, source, reference, 2, 'mask', 0, {strip(mask_lex('source'))} from samples
  union all select doc_id, line_no, source, reference, 3, 'half', 0,
         array_to_string(tk[1:cast(ceil(len(tk) / 2) as integer)], ' ')
         from (select *, {split_ws('source')} as tk from samples) h
  union all select doc_id, line_no, source, reference, 3, 'half', 1,
         array_to_string(tk[cast(ceil(len(tk) / 2) as integer) + 1:len(tk)], ' ')
         from (select *, {split_ws('source')} as tk from samples) h)"""


def _fl_logit(x: str) -> str:
    tk = split_ws(x)
    words = f"len(list_filter({tk}, lambda t: regexp_full_match(t, '[A-Za-z]+[.,!?;:''\"]*')))"
    share = f"(case when len({tk}) > 0 then cast({words} as double) / cast(len({tk}) as double) else 0e0 end)"
    short = f"(case when len({tk}) < 3 then 2e0 else 0e0 end)"
    return f"(8e0 * {share} + -4e0 - {short})"


def _tox(x: str) -> str:
    return f"(1e0 - exp(-1e0 * cast({lex_hits(x)} as double)))"


def bow_ctes(src: str, id_cols: str, a: str, b: str, p: str = "w") -> str:
    """CTEs with the bag-of-token cosine ``{p}_cos(ids..., sim)``."""
    from .oracle_sql import _on, _qual
    lower_split = lambda e: split_ws(f"lower({e})")
    return f"""
{p}_ta as (select {id_cols}, unnest({lower_split(a)}) as tok from {src}),
{p}_tb as (select {id_cols}, unnest({lower_split(b)}) as tok from {src}),
{p}_ca as (select {id_cols}, tok, count(*) as c from {p}_ta group by all),
{p}_cb as (select {id_cols}, tok, count(*) as c from {p}_tb group by all),
{p}_dot as (select {_qual(id_cols, 'h')}, sum(h.c * r.c) as d
            from {p}_ca h join {p}_cb r on {_on(id_cols)} and h.tok = r.tok group by all),
{p}_na as (select {id_cols}, sum(c * c) as n from {p}_ca group by all),
{p}_nb as (select {id_cols}, sum(c * c) as n from {p}_cb group by all),
{p}_cos as (select {_qual(id_cols, 's')},
                   case when coalesce(na.n, 0) > 0 and coalesce(nb.n, 0) > 0
                        then cast(coalesce(d.d, 0) as double) / sqrt(cast(na.n as double) * cast(nb.n as double))
                        else 0e0 end as sim
            from {src} s left join {p}_na na on {_on(id_cols, 's', 'na')}
                         left join {p}_nb nb on {_on(id_cols, 's', 'nb')}
                         left join {p}_dot d on {_on(id_cols, 's', 'd')})"""


_KEYS = "doc_id, line_no, model_idx, candidate_rank"
SCORED = with_(LINE_SAMPLES, SAMPLES, CANDS,
               bow_ctes("cands", _KEYS, "text", "source"),
               bleu_stats_ctes("cands", _KEYS, "text", "reference")) + f""",
scored0 as (
  select c.doc_id, c.line_no, c.model_idx, c.model, c.candidate_rank, c.text, c.source, c.reference,
         1e0 - {_tox('c.text')} as STA_PROB,
         1e0 / (1e0 + exp(-{_fl_logit('c.text')})) as FL_PROB,
         case when {_fl_logit('c.text')} > 0 then 1e0 else 0e0 end as FL,
         w.sim as SIM, {bleu_expr('b.')} as BLEU,
         b.c1, b.c2, b.c3, b.c4, b.t1, b.t2, b.t3, b.t4, b.hyp_len, b.ref_len
  from cands c join w_cos w using (doc_id, line_no, model_idx, candidate_rank)
               join b_stats b using (doc_id, line_no, model_idx, candidate_rank)),
scored1 as (
  select *, case when STA_PROB >= 0.5e0 then 1e0 else 0e0 end as STA, BLEU / 100e0 as BLEU_NORM,
         STA_PROB * SIM * FL_PROB as J
  from scored0),
scored as (
  select *, STA * SIM * FL as J_BINARY,
         0e0 + 1e0 * J + 0.25e0 * BLEU_NORM + 0.1e0 * SIM + 0.2e0 * FL_PROB as objective
  from scored1),
best as (
  select * from (select *, row_number() over (partition by doc_id, line_no order by
                   (case when objective is null or isnan(objective) then 1 else 0 end),
                   objective desc, model_idx, candidate_rank) as rn from scored) r
  where rn = 1)"""

_SC = ["STA_PROB", "STA", "FL_PROB", "FL", "SIM", "BLEU", "BLEU_NORM", "J", "J_BINARY"]

ORACLE["candidate_explode"] = with_(LINE_SAMPLES, SAMPLES, CANDS) + """
select doc_id, line_no, cast(model_idx as integer) as model_idx, model,
       cast(candidate_rank as integer) as candidate_rank, text from cands"""

ORACLE["toxicity_lexicon"] = with_(LINE_SAMPLES) + f"""
select line_samples.doc_id, line_no, toxic, cast({lex_hits('source')} as bigint) as hits, round({_tox('source')}, 6) as p_toxic,
       cast({_tox('source')} < 0.5 as integer) as non_toxic
from line_samples left join labels on labels.doc_id = line_samples.doc_id"""

ORACLE["fluency_features"] = with_(LINE_SAMPLES) + f"""
select doc_id, line_no, round(1e0 / (1e0 + exp(-{_fl_logit('source')})), 6) as fl_prob,
       cast({_fl_logit('source')} > 0 as integer) as fl_label
from line_samples"""

ORACLE["bow_cosine"] = with_(LINE_SAMPLES, SAMPLES, bow_ctes("samples", "doc_id, line_no", "source", "reference")) + """
select doc_id, line_no, round(sim, 6) as sim from w_cos"""

ORACLE["score_candidates"] = SCORED + f"""
select doc_id, line_no, cast(model_idx as integer) as model_idx, cast(candidate_rank as integer) as candidate_rank,
       {', '.join(f'round({c}, 6) as {c}' for c in _SC)}
from scored"""

ORACLE["objective_score"] = SCORED + """
select doc_id, line_no, cast(model_idx as integer) as model_idx, cast(candidate_rank as integer) as candidate_rank,
       round(objective, 6) as objective from scored"""

ORACLE["rerank_top1"] = SCORED + """
select doc_id, line_no, cast(model_idx as integer) as model_idx, model,
       cast(candidate_rank as integer) as candidate_rank, round(objective, 6) as objective from best"""

ORACLE["rerank_all_candidates"] = SCORED + f"""
select doc_id, line_no, model, cast(candidate_rank as integer) as candidate_rank, text, round(objective, 6) as objective,
       {', '.join(f'round({c}, 6) as {c}' for c in ["STA", "STA_PROB", "FL", "FL_PROB", "SIM", "BLEU", "BLEU_NORM", "J", "J_BINARY"])}
from scored"""

ORACLE["rerank_selected"] = SCORED + """
select doc_id, line_no, source as toxic, reference, text as model_output, model as chosen_model,
       cast(candidate_rank as integer) as candidate_rank, round(objective, 6) as objective,
       round(STA_PROB, 6) as sta_prob, round(STA, 6) as sta, round(SIM, 6) as sim,
       round(FL_PROB, 6) as fl_prob, round(FL, 6) as fl, round(BLEU, 6) as bleu, round(J, 6) as j_prob
from best"""

ORACLE["rerank_metrics"] = SCORED + f"""
select n, round({bleu_expr('', effective=False)}, 6) as BLEU, round(STA, 6) as STA, round(SIM, 6) as SIM,
       round(FL, 6) as FL, round(STA * SIM * FL, 6) as J
from (select cast(count(*) as bigint) as n, sum(c1) as c1, sum(c2) as c2, sum(c3) as c3, sum(c4) as c4,
             sum(t1) as t1, sum(t2) as t2, sum(t3) as t3, sum(t4) as t4, sum(hyp_len) as hyp_len,
             sum(ref_len) as ref_len, avg(round(STA)) as STA, avg(SIM) as SIM, avg(round(FL)) as FL
      from best) m"""


# --- part 2: text rules, sampling, bundles, vectors, rewards, logs, reports -------------

from .oracle_sql import RUNS, VEC_PAIRS  # noqa: E402

ORACLE["text_normalize"] = with_(PAIRS_WIDE) + f"""
select conv_id, turn, {strip('toxic')} as toxic_clean, cast(length({strip('toxic')}) as bigint) as n_chars,
       cast(len({split_ws('toxic')}) as bigint) as n_tokens
from pairs_wide"""

ORACLE["blank_placeholder"] = with_(LINE_SAMPLES, SAMPLES, CANDS) + f"""
select doc_id, line_no, cast(model_idx as integer) as model_idx, cast(candidate_rank as integer) as candidate_rank,
       case when text is null or {strip('text')} = '' then ' ' else {strip('text')} end as model_output
from cands"""

ORACLE["reference_fallback"] = with_(PAIRS_WIDE) + """
select conv_id, turn, coalesce(nullif(neutral2, ''), toxic) as reference from pairs_wide"""

ORACLE["truncate_tokens"] = f"""
select doc_id, cast(len(tk) as bigint) as n_tokens, md5(array_to_string(tk[1:128], ' ')) as truncated_md5
from (select doc_id, {split_ws('text')} as tk from documents) t"""

ORACLE["eval_dropna"] = with_(PAIRS_WIDE) + """
select conv_id, turn, toxic, neutral1, neutral2 from pairs_wide
where toxic is not null and neutral1 is not null and neutral2 is not null"""

TRIPLES = f"""
triples as (
  select s.doc_id, s.line_no, s.source as toxic, s.reference as neutral1, {strip(mask_lex('s.source'))} as model_output
  from samples s)"""

ORACLE["align_predictions"] = with_(LINE_SAMPLES, SAMPLES, TRIPLES) + """
select doc_id, line_no, toxic, neutral1, case when known then model_output end as model_output, known as matched
from (select *, doc_id in (select doc_id from labels) as known from triples) t"""

ORACLE["sample_head"] = with_(PAIRS_WIDE, PAIRS_LONG) + """
select conv_id, turn, cast(target_no as integer) as target_no, input from pairs_long
order by conv_id, turn, target_no limit 100"""

ORACLE["sample_random"] = with_(LINE_SAMPLES) + """
select doc_id, line_no, source from line_samples
order by md5(concat_ws('|', '42', doc_id, line_no)), doc_id, line_no limit 100"""


def _ranked_pairs(seed: int) -> str:
    return f"""(select conv_id, turn, target_no,
        cast(row_number() over (order by md5(concat_ws('|', '{seed}', conv_id, turn, target_no)), conv_id, turn, target_no) - 1
             as bigint) as rank,
        count(*) over () as total from pairs_long)"""


ORACLE["split_exact"] = with_(PAIRS_WIDE, PAIRS_LONG) + f"""
select conv_id, turn, cast(target_no as integer) as target_no, rank,
       case when rank < total - ceil(0.2e0 * total) then 'train'
            when rank < total - ceil(0.2e0 * total) + (ceil(0.2e0 * total) - ceil(0.5e0 * ceil(0.2e0 * total)))
            then 'validation' else 'test' end as split
from {_ranked_pairs(42)} r"""

ORACLE["batch_assign"] = with_(PAIRS_WIDE, PAIRS_LONG) + f"""
select conv_id, turn, cast(target_no as integer) as target_no, cast(rank // 16 as bigint) as batch_id,
       cast(rank % 16 as integer) as batch_pos
from {_ranked_pairs(42)} r"""

ORACLE["batch_cycle"] = with_(PAIRS_WIDE, PAIRS_LONG) + " " + " union all ".join(f"""
select conv_id, turn, cast(target_no as integer) as target_no, {p} as pass_no,
       cast({p} * ceil(total / 16e0) + rank // 16 + 1 as bigint) as step, cast(rank // 16 as bigint) as batch_id
from {_ranked_pairs(42 + p)} r{p}""" for p in range(2))

ORACLE["dense_ids"] = with_(PAIRS_WIDE, PAIRS_LONG) + """
select conv_id, turn, cast(target_no as integer) as target_no,
       cast(row_number() over (order by conv_id, turn, target_no) - 1 as bigint) as row_id
from pairs_long"""


def _bundle(src: str, by: str = "") -> str:
    """Evaluate (toxic, neutral1, model_output) rows of ``src`` keyed by ``k``."""
    g = f"{by}, " if by else ""
    return with_(bow_ctes(src, "k", "toxic", "model_output", p="e"),
                 bleu_stats_ctes(src, "k", "model_output", "neutral1", prefix="eb"))[5:] + f""",
per_row as (
  select {('x.' + by + ', ') if by else ''}x.k, cast({_tox('x.model_output')} < 0.5 as double) as nt,
         cast({_fl_logit('x.model_output')} > 0 as double) as fl, w.sim, b.c1, b.c2, b.c3, b.c4,
         b.t1, b.t2, b.t3, b.t4, b.hyp_len, b.ref_len
  from {src} x join e_cos w on w.k = x.k join eb_stats b on b.k = x.k),
agg as (
  select {g}cast(count(*) as bigint) as n, sum(c1) as c1, sum(c2) as c2, sum(c3) as c3, sum(c4) as c4,
         sum(t1) as t1, sum(t2) as t2, sum(t3) as t3, sum(t4) as t4, sum(hyp_len) as hyp_len,
         sum(ref_len) as ref_len, avg(nt) as STA, avg(sim) as SIM, avg(fl) as FL
  from per_row {('group by ' + by) if by else ''})
select {g}n, round({bleu_expr('', effective=False)}, 6) as BLEU, round(STA, 6) as STA, round(SIM, 6) as SIM,
       round(FL, 6) as FL, round(STA * SIM * FL, 6) as J
from agg"""


ORACLE["metric_bundle"] = with_(LINE_SAMPLES, SAMPLES, TRIPLES,
                                "tri as (select row_number() over () as k, * from triples)") + "," + _bundle("tri")

DOC_LINES = """
doc_lines as (
  select row_number() over () as k, lang, line from (
    select d.lang, string_split(d.text, chr(10))[i + 1] as line
    from documents d, unnest(range(0, len(string_split(d.text, chr(10))))) as r(i)) t)"""

ORACLE["metric_bundle_by_lang"] = with_(DOC_LINES) + f""",
lang_rows as (select k, lang, line as toxic, {reference('line')} as neutral1,
                     {strip(mask_lex('line'))} as model_output from doc_lines),""" + _bundle("lang_rows", "lang")

ORACLE["metric_bundle_updated"] = with_(PAIRS_WIDE, PAIRS_LONG) + f""",
held as (select concat_ws('|', conv_id, turn, target_no) as k, cast(target_no as integer) as target_no, input as toxic,
                target as neutral1,
                case when conv_id % 64 % 2 = 0 then array_to_string(toks[1:cast(ceil(len(toks) / 2e0) as bigint)], ' ')
                     else input end as model_output
         from (select *, {split_ws('input')} as toks from pairs_long) p),""" + _bundle("held", "target_no")

ORACLE["late_rerank"] = with_(PAIRS_WIDE, PAIRS_LONG, bow_ctes("pairs_long", "conv_id, turn, target_no", "input", "target", p="e")) + f"""
select conv_id, turn, candidate_rank, text, round(objective, 6) as objective, n_seen, true as complete
from (select p.conv_id, p.turn, cast(p.target_no - 1 as integer) as candidate_rank, p.target as text, s.objective,
             cast(count(*) over (partition by p.conv_id, p.turn) as bigint) as n_seen,
             row_number() over (partition by p.conv_id, p.turn order by s.objective desc, p.target_no) as place
      from pairs_long p join (
        select x.conv_id, x.turn, x.target_no,
               (1e0 - {_tox('x.target')}) * w.sim * (1e0 / (1e0 + exp(-{_fl_logit('x.target')}))) as objective
        from pairs_long x join e_cos w on w.conv_id = x.conv_id and w.turn = x.turn and w.target_no = x.target_no) s
        on s.conv_id = p.conv_id and s.turn = p.turn and s.target_no = p.target_no) r
where place = 1"""

ORACLE["logits_softmax_argmax"] = """
select vec_id, cast(list_position(embedding, list_max(embedding)) - 1 as integer) as top,
       round(list_max(sm), 6) as p_top, round(list_sum(sm), 6) as p_sum
from (select vec_id, embedding, list_transform(ex, lambda x: x / list_sum(ex)) as sm
      from (select vec_id, embedding,
                   list_transform(embedding, lambda x: exp(cast(x as double) - cast(list_max(embedding) as double))) as ex
            from embeddings) a) b"""

ORACLE["pair_cosine"] = with_(VEC_PAIRS) + """
select vec_id, la, lb,
       round(case when na > 0 and nb > 0 then d / (na * nb) else 0e0 end, 6) as cos,
       round(sqrt(list_sum(list_transform(va, lambda x: (cast(x as double) / na) * (cast(x as double) / na)))), 6) as norm_a
from (select *, sqrt(list_sum(list_transform(va, lambda x: cast(x as double) * cast(x as double)))) as na,
             sqrt(list_sum(list_transform(vb, lambda x: cast(x as double) * cast(x as double)))) as nb,
             list_sum(list_transform(list_zip(va, vb), lambda p: cast(p[1] as double) * cast(p[2] as double))) as d
      from vec_pairs) v"""

ORACLE["style_centroid"] = """
with u as (select vec_id, label, i, cast(embedding[i] as double) as x
           from embeddings, unnest(range(1, len(embedding) + 1)) as r(i)),
c as (select label, i, avg(x) as cx from u group by label, i),
d as (select u.vec_id, u.label, sum(u.x * c.cx) as dd, sum(u.x * u.x) as na, sum(c.cx * c.cx) as nb
      from u join c on u.label = c.label and u.i = c.i group by u.vec_id, u.label)
select vec_id, label, round(case when na > 0 and nb > 0 then dd / (sqrt(na) * sqrt(nb)) else 0e0 end, 6) as score
from d"""


def _clip(x: str, lo: float, hi: float) -> str:
    return f"greatest(cast({lo!r} as double), least(cast({hi!r} as double), {x}))"


CAND_BOW = with_(LINE_SAMPLES, SAMPLES, CANDS, bow_ctes("cands", _KEYS, "source", "text"))

ORACLE["reward_base"] = CAND_BOW + f"""
select c.doc_id, c.line_no, cast(c.model_idx as integer) as model_idx, cast(c.candidate_rank as integer) as candidate_rank,
       cast(triv as integer) as trivial,
       round({_clip("(0.7e0 * (1e0 - (1e0 - exp(-2e0 * cast(hits as double)))) + 0.3e0 * " + _clip('w.sim', -1.0, 1.0) + ") - (case when triv then 0.2e0 else 0e0 end)", -1.0, 1.0)}, 6) as reward
from (select *, {lex_hits('text')} as hits,
             (len({split_ws('text')}) < 3 or {strip('text')} = {strip('source')}) as triv from cands) c
     join w_cos w using (doc_id, line_no, model_idx, candidate_rank)"""

ORACLE["mini_metrics"] = with_(LINE_SAMPLES, SAMPLES, CANDS, bow_ctes("cands", _KEYS, "source", "text"),
                               bleu_stats_ctes("cands", _KEYS, "coalesce(text, '')", "coalesce(reference, '')")) + f""",
mm as (
  select c.doc_id, c.line_no, c.model_idx, c.candidate_rank,
         {_clip("1e0 - " + _tox('c.text'), 0.0, 1.0)} as sta,
         {_clip("1e0 / (1e0 + exp(-" + _fl_logit('c.text') + "))", 0.0, 1.0)} as fl,
         0.5e0 * ({_clip('w.sim', -1.0, 1.0)} + 1e0) as sim,
         {_clip(bleu_expr('b.') + " / 100e0", 0.0, 1.0)} as bleu
  from cands c join w_cos w using (doc_id, line_no, model_idx, candidate_rank)
               join b_stats b using (doc_id, line_no, model_idx, candidate_rank))
select doc_id, line_no, cast(model_idx as integer) as model_idx, cast(candidate_rank as integer) as candidate_rank,
       round(sta, 6) as sta, round(sim, 6) as sim, round(fl, 6) as fl, round(bleu, 6) as bleu,
       round({_clip('sta * sim * fl', 0.0, 1.0)}, 6) as j
from mm"""

# candidate rows with mini metrics and base reward, in steps of 16 successive lines
REWARDED = ORACLE["mini_metrics"].rsplit("select doc_id", 1)[0] + f""",
rew as (
  select c.*, m.sta, m.sim, m.fl, m.bleu,
         {_clip('m.sta * m.sim * m.fl', 0.0, 1.0)} as j, (c.line_no // 16 + 1)::bigint as step,
         {_clip("(0.7e0 * (1e0 - (1e0 - exp(-2e0 * cast(hits as double)))) + 0.3e0 * " + _clip('w.sim', -1.0, 1.0) + ") - (case when triv then 0.2e0 else 0e0 end)", -1.0, 1.0)} as reward_raw
  from (select *, {lex_hits('text')} as hits,
               (len({split_ws('text')}) < 3 or {strip('text')} = {strip('source')}) as triv from cands) c
       join w_cos w using (doc_id, line_no, model_idx, candidate_rank)
       join mm m using (doc_id, line_no, model_idx, candidate_rank))"""

_BATCH = "over (partition by doc_id, step)"
BLENDED = REWARDED + f""",
rz as (select *,
   {_clip(f"(j - avg(j) {_BATCH}) / (stddev_pop(j) {_BATCH} + 1e-6)", -2.5, 2.5)} as z_j,
   {_clip(f"(bleu - avg(bleu) {_BATCH}) / (stddev_pop(bleu) {_BATCH} + 1e-6)", -2.5, 2.5)} as z_bleu from rew),
rw as (select *, 0.8e0 + (case when step % 2 = 0 then 0.4e0 else 0e0 end) as tw,
   0.8e0 * z_j + (case when step % 2 = 0 then 0.4e0 * z_bleu else 0e0 end) as contrib from rz),
rr as (select *, reward_raw * greatest(0e0, 1e0 - tw) + contrib as reward from rw)"""

_IDS = """doc_id, line_no, cast(model_idx as integer) as model_idx, cast(candidate_rank as integer) as candidate_rank"""

ORACLE["reward_zscore"] = BLENDED + f"""
select {_IDS}, step, round(z_j, 6) as z_j from rz"""

ORACLE["reward_blend"] = BLENDED + f"""
select {_IDS}, step, round(reward, 6) as reward from rr"""

ORACLE["reward_batch_stats"] = BLENDED + """
select doc_id, step, round(avg(z_j), 6) as metric_reward_mean, round(stddev_samp(z_j), 6) as metric_reward_std,
       round(avg(sta), 6) as metric_sta_mean, round(avg(sim), 6) as metric_sim_mean,
       round(avg(fl), 6) as metric_fl_mean, round(avg(j), 6) as metric_j_mean,
       round(avg(case when step % 2 = 0 then z_bleu end), 6) as bleu_reward_mean,
       round(stddev_samp(case when step % 2 = 0 then z_bleu end), 6) as bleu_reward_std,
       round(avg(case when step % 2 = 0 then bleu end), 6) as metric_bleu_mean,
       round(avg(reward), 6) as reward_mean
from rr group by doc_id, step"""

ORACLE["eval_summary"] = REWARDED + """
select model, cast(count(*) as bigint) as samples, round(avg(1e0 - sta), 6) as toxicity_mean,
       round(stddev_pop(1e0 - sta), 6) as toxicity_std, round(avg(sim), 6) as similarity_mean,
       round(avg(reward_raw), 6) as reward_mean, round(stddev_pop(reward_raw), 6) as reward_std
from rew group by model"""

ORACLE["eval_preview"] = REWARDED + """
select model, doc_id, line_no, cast(candidate_rank as integer) as candidate_rank, source as prompt, reference,
       text as prediction, round(1e0 - sta, 6) as toxicity, round(sim, 6) as similarity, round(reward_raw, 6) as reward
from (select *, row_number() over (partition by model order by doc_id, line_no, candidate_rank) as rn from rew) r
where rn <= 5"""

ORACLE["forward_fill"] = """
select conv_id, turn, last_value(case when role = 'user' then turn end ignore nulls)
       over (partition by conv_id order by turn rows unbounded preceding) as last_user_turn
from conversations"""

RUN_ROWS = """
run_rows as (
  select model || '-' || variant as Model, 100e0 * STA * FL as BLEU, STA,
         cast(n as double) / (cast(n as double) + 1e0) as SIM, FL,
         STA * (cast(n as double) / (cast(n as double) + 1e0)) * FL as J
  from runs)"""

ORACLE["run_summary"] = with_(RUNS, RUN_ROWS) + """
select Model, round(BLEU, 4) as BLEU, round(STA, 4) as STA, round(SIM, 4) as SIM, round(FL, 4) as FL,
       round(J, 4) as J
from run_rows"""

ORACLE["run_matrix"] = with_(RUNS) + """
select m.model, v.variant, case when r.STA < 1 then printf('%.4f', r.STA) else 'N/A' end as STA,
       case when r.STA < 1 then printf('%.4f', r.FL) else 'N/A' end as FL,
       case when r.STA < 1 then 'ok' when r.STA = 1 then 'ValueError: no toxic rows among ' || r.n else 'missing' end as status
from (select distinct model from runs) m cross join (values ('de'), ('en'), ('es'), ('fr')) v(variant)
left join runs r on r.model = m.model and r.variant = v.variant"""

ORACLE["ablation_complete"] = with_(RUNS) + """
select model from runs where variant in ('de', 'en', 'es', 'fr')
group by model having count(distinct variant) = 4"""

ORACLE["ablation_pivot"] = with_(RUNS) + """
select model, round(max(case when variant = 'de' then STA end), 6) as de,
       round(max(case when variant = 'en' then STA end), 6) as en,
       round(max(case when variant = 'es' then STA end), 6) as es,
       round(max(case when variant = 'fr' then STA end), 6) as fr
from runs group by model"""

ORACLE["ablation_delta"] = with_(RUNS) + """
select o.model, o.variant, round(o.STA - b.STA, 6) as delta_STA, round(o.FL - b.FL, 6) as delta_FL
from runs o join runs b on b.model = o.model and b.variant = 'en'
where o.variant <> 'en' and o.model in (
  select model from runs where variant in ('de', 'en', 'es', 'fr') group by model having count(distinct variant) = 4)"""

ORACLE["registry_entries"] = """
with fams as (
  select distinct 'sft' as family, source as model, 16 as own, '{}' as generation from documents where lang = 'en'
  union all select distinct 'rl', source, 8, '{"do_sample": true, "early_stopping": false}' from documents where lang in ('de', 'fr')
  union all select distinct 'baseline', source, null, '{}' from documents where lang = 'es'),
hints as (select source as model, case when avg(n_chars) > 2500 then 4 when avg(n_chars) > 1500 then 32 end as hint
          from documents group by source),
labelled as (select distinct d.source as model from labels l join documents d on d.doc_id = l.doc_id)
select f.family, f.model, f.model || '-' || f.family as name, 'models/' || f.family || '/' || f.model as path, f.generation,
       cast(case when f.own is null then h.hint when h.hint is null then f.own when h.hint < f.own then h.hint else f.own end as integer) as batch_size
from fams f join hints h on h.model = f.model
where f.model in (select model from labelled)"""


def _no_negative_zero(sql: str) -> str:
    """Wrap every ``round(...)`` as ``(round(...) + 0e0)``: IEEE -0.0 + 0.0 is
    +0.0, and Spark's decimal-based round never yields -0.0."""
    out, i = [], 0
    while True:
        j = sql.find("round(", i)
        if j < 0:
            out.append(sql[i:])
            return "".join(out)
        if j > 0 and (sql[j - 1].isalnum() or sql[j - 1] == "_"):
            out.append(sql[i:j + 6])
            i = j + 6
            continue
        depth, k = 0, j + 5
        while True:
            if sql[k] == "(":
                depth += 1
            elif sql[k] == ")":
                depth -= 1
                if depth == 0:
                    break
            k += 1
        out.append(sql[i:j] + "(round(" + _no_negative_zero(sql[j + 6:k]) + ") + 0e0)")
        i = k + 1


for _k in list(ORACLE):
    ORACLE[_k] = _no_negative_zero(ORACLE[_k])


ORACLE["toxicity_udf"] = _no_negative_zero(with_(LINE_SAMPLES) + f"""
select doc_id, line_no, round({_tox('source')}, 6) as p_toxic from line_samples""")


# --- learnt generator --------------------------------------------------------------

def _em_round(n: int) -> str:
    """One round of expectation maximisation over ``em_both``, from the table of the round before."""
    seen = "(select *, 1e0 as p from em_both)" if n == 1 else f"(select b.*, x.p from em_both b join em_{n - 1} x using (s, t))"
    return f"""
em_e{n} as (
  select s, t, sum(ct * (cs * p) / den) as e
  from (select *, sum(cs * p) over (partition by conv_id, turn, target_no, t) as den from {seen}) w group by s, t),
em_{n} as (select s, t, e / sum(e) over (partition by s) as p from em_e{n})"""


WORD_OPTIONS = f"""
em_src as (
  select conv_id, turn, target_no, s, count(*) as cs
  from (select conv_id, turn, target_no, unnest(list_concat([''], {split_ws('input')})) as s from pairs_long) w group by all),
em_tgt as (
  select conv_id, turn, target_no, t, count(*) as ct
  from (select conv_id, turn, target_no, unnest({split_ws('target')}) as t from pairs_long) w group by all),
em_both as (select * from em_src join em_tgt using (conv_id, turn, target_no)),""" + ",".join(map(_em_round, (1, 2, 3))) + """,
opts as (
  select s, cast(row_number() over (partition by s order by p desc, t) - 1 as integer) as rank,
         cast(round(-ln(p) * 1000000) as bigint) as cost, t as target
  from (select s, t, round(p, 9) as p from em_3) w where s <> '' and p >= 0.05 qualify rank < 4)"""

ORACLE["word_options"] = with_(PAIRS_WIDE, PAIRS_LONG, WORD_OPTIONS) + """
select s, rank, cost, target from opts"""

ORACLE["aligned_rewrites"] = with_(PAIRS_WIDE, PAIRS_LONG, WORD_OPTIONS, LINE_SAMPLES) + f""",
toks as (
  select doc_id, line_no, u.i as pos, tk[u.i] as tok
  from (select doc_id, line_no, {split_ws('source')} as tk from line_samples) l, unnest(range(1, len(tk) + 1)) as u(i)),
words as (
  select w.doc_id, w.line_no, w.pos, coalesce(o.target, w.tok) as word, w.tok, o.cost
  from toks w left join opts o on o.s = w.tok and o.rank = 0),
devs as (
  select doc_id, line_no, pos, target, n from (
    select w.doc_id, w.line_no, w.pos, o.target,
           row_number() over (partition by w.doc_id, w.line_no order by o.cost - w.cost, w.pos, o.rank) as n
    from words w join opts o on o.s = w.tok and o.rank between 1 and 2) d where n <= 2)
select l.doc_id, l.line_no, 0 as candidate_rank, coalesce(string_agg(w.word, ' ' order by w.pos), '') as text
from line_samples l left join words w on w.doc_id = l.doc_id and w.line_no = l.line_no group by l.doc_id, l.line_no
union all
select d.doc_id, d.line_no, cast(d.n as integer), string_agg(case when w.pos = d.pos then d.target else w.word end, ' ' order by w.pos)
from devs d join words w on w.doc_id = d.doc_id and w.line_no = d.line_no group by d.doc_id, d.line_no, d.n"""


ORACLE["retrieved_rewrites"] = with_(LINE_SAMPLES) + f""",
styled as (
  select s.doc_id, s.line_no, s.source as text, l.style, {split_ws("lower(coalesce(s.source, ''))")} as w
  from line_samples s join (select doc_id, max(toxic) as style from labels group by doc_id) l on l.doc_id = s.doc_id
  where l.style in (0, 1)),
grams as (
  select doc_id, line_no, style, u.i as pos, 1 as n, w[u.i] as gram from styled, unnest(range(1, len(w) + 1)) as u(i)
  union all
  select doc_id, line_no, style, u.i, 2, w[u.i] || ' ' || w[u.i + 1] from styled, unnest(range(1, len(w))) as u(i)),
totals as (select count(case when style = 0 then 1 end) as l0, count(case when style = 1 then 1 end) as l1 from styled),
marks as (
  select gram, case when n0 >= 3 and (n0 + 1) * l1 >= 5 * (n1 + 1) * l0 then 0 else 1 end as style
  from (select gram, count(case when style = 0 then 1 end) as n0, count(case when style = 1 then 1 end) as n1 from grams group by gram) g, totals
  where l0 > 0 and l1 > 0 and ((n0 >= 3 and (n0 + 1) * l1 >= 5 * (n1 + 1) * l0) or (n1 >= 3 and (n1 + 1) * l0 >= 5 * (n0 + 1) * l1))),
gone as (
  select distinct doc_id, line_no, pos + d as pos from grams join marks using (gram, style), unnest(range(0, n)) as r(d)),
kept as (
  select g.doc_id, g.line_no, g.style, g.pos, g.gram as word from grams g
  where g.n = 1 and not exists (select 1 from gone x where x.doc_id = g.doc_id and x.line_no = g.line_no and x.pos = g.pos)),
words as (select distinct doc_id, line_no, style, word from kept),
sizes as (select doc_id, line_no, count(*) as n from words group by doc_id, line_no),
shares as (
  select a.doc_id, a.line_no, b.doc_id as near_doc_id, b.line_no as near_line_no, count(*) as shared
  from words a join words b on a.word = b.word and a.style = 1 and b.style = 0 group by all),
best as (
  select s.doc_id, s.line_no, near_doc_id, near_line_no, shared, x.n + y.n - shared as either
  from shares s join sizes x on x.doc_id = s.doc_id and x.line_no = s.line_no
       join sizes y on y.doc_id = near_doc_id and y.line_no = near_line_no
  where 2 * shared >= x.n + y.n - shared
  qualify row_number() over (partition by s.doc_id, s.line_no
                             order by cast(shared as double) / (x.n + y.n - shared) desc, near_doc_id, near_line_no) = 1),
contents as (
  select l.doc_id, l.line_no, cast(len(l.w) - count(k.word) as integer) as n_deleted,
         coalesce(string_agg(k.word, ' ' order by k.pos), '') as content
  from styled l left join kept k on k.doc_id = l.doc_id and k.line_no = l.line_no where l.style = 1
  group by l.doc_id, l.line_no, len(l.w))
select c.doc_id, c.line_no, c.n_deleted, c.content, b.near_doc_id, b.near_line_no, b.shared, b.either,
       case when b.near_doc_id is null then c.content else t.text end as text
from contents c left join best b on b.doc_id = c.doc_id and b.line_no = c.line_no
     left join styled t on t.doc_id = b.near_doc_id and t.line_no = b.near_line_no"""


# --- language model ----------------------------------------------------------------

def _grams(name: str, src: str) -> str:
    """Trigrams of the padded texts of ``src``."""
    return f"""
{name} as (
  select doc_id, w[u.i] as a, w[u.i + 1] as b, w[u.i + 2] as c
  from (select doc_id, list_concat([' <', ' <'], {split_ws("lower(coalesce(text, ''))")}, [' >']) as w from {src}) x,
       unnest(range(1, len(w) - 1)) as u(i))"""


def _kn(name: str, counts: str, context: str) -> str:
    """Discounted shares ``{name}_p`` and left-over mass ``{name}_g`` of one order."""
    cols = f"{context}," if context else ""
    on = f"using ({context})" if context else "on true"
    cut = []
    for i in (1, 2, 3):
        value = f"({i}e0 - {i + 1} * (n1 / (n1 + 2 * n2)) * n{i + 1} / n{i})"
        cut.append(f"case when n1 > 0 and n{i} > 0 and n{i + 1} > 0 and {value} > 0 then least({i}e0, {value}) else 0.75e0 end as d{i}")
    met = ", ".join(f"cast(count(case when n = {i} then 1 end) as double) as n{i}" for i in (1, 2, 3, 4))
    return f"""
{name}_d as (select {', '.join(cut)} from (select {met} from {counts}) m),
{name}_c as (select x.*, least(cast(n as double), case when n = 1 then d1 when n = 2 then d2 else d3 end) as cut from {counts} x, {name}_d),
{name}_g as (select {cols} cast(sum(n) as double) as total, sum(cut) / sum(n) as gamma from {name}_c {'group by ' + context if context else ''}),
{name}_p as (select x.*, (n - cut) / total as p from {name}_c x join {name}_g g {on})"""


ORACLE["acceptability_lm"] = with_(
    """
good as (select * from documents where doc_id in (select doc_id from labels where quality = 1 and doc_id % 2 = 0))""",
    _grams("train_g", "good"), _grams("all_g", "documents"), """
tri as (select a, b, c, count(*) as n from train_g group by a, b, c),
bi as (select b, c, count(*) as n from tri group by b, c),
uni as (select c, count(*) as n from bi group by c)""", _kn("kt", "tri", "a, b"), _kn("kb", "bi", "b"), _kn("ku", "uni", ""), """
rest as (select gamma / (select count(*) + 1 from uni) as rest from ku_g)""") + """
select g.doc_id, cast(count(*) - 1 as bigint) as n_tokens,
       round(sum(ln(coalesce(t.p, 0) + coalesce(tg.gamma, 1) * (coalesce(b.p, 0) + coalesce(bg.gamma, 1) * (coalesce(u.p, 0) + rest)))) / count(*), 6) as logp
from all_g g left join kt_p t using (a, b, c) left join kt_g tg using (a, b) left join kb_p b on b.b = g.b and b.c = g.c
  left join kb_g bg on bg.b = g.b left join ku_p u on u.c = g.c, rest
group by g.doc_id"""
