"""SQL that gives the same rows as the queries, where SQL can express them."""

from __future__ import annotations

from .licences import TEMPLATES, size_bounds, template_bigrams

_SPACE = r"[\x20\x09-\x0D]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

_rows = ", ".join(
    f"('{name}', [{', '.join(repr(g) for g in template_bigrams(text))}], {size_bounds(len(template_bigrams(text)), 0.8)[0]}, {size_bounds(len(template_bigrams(text)), 0.8)[1]})" for name, texts in sorted(TEMPLATES.items()) for text in texts
)

OP1 = rf"""with d as (select doc_id, lower(coalesce(text, '')) as text from documents),
 l as (select doc_id, unnest(string_split(text, chr(10))) as line from d),
 p as (select doc_id, text as passage from d union select doc_id, line from l union select doc_id, unnest(string_split(regexp_replace(line, '([.!?]){_SPACE}', '\1' || chr(1), 'g'), chr(1))) from l),
 w as (select doc_id, list_filter(string_split_regex(passage, '[^a-z0-9]+'), lambda x: x <> '') as words from p),
 g as (select doc_id, list_distinct(list_transform(range(1, len(words)), lambda i: words[i] || ' ' || words[i + 1])) as grams from w where len(words) >= 2),
 t(name, mine, low, high) as (values {_rows}),
 m as (select doc_id, row_number() over () as k, grams from g),
 s as (select doc_id, k, name, 2.0 * len(list_intersect(grams, mine)) / (len(grams) + len(mine)) as dice from m join t on len(grams) between low and high),
 best as (select doc_id, name, dice from s where dice >= 0.8 qualify row_number() over (partition by k order by dice desc, name) = 1),
 f as (select doc_id, string_agg(distinct name, ',' order by name) as licences, count(*) as n, max(dice) as dice from best group by doc_id),
 top as (select doc_id, name from best qualify row_number() over (partition by doc_id order by dice desc, name) = 1)
 select d.doc_id, coalesce(f.licences, '') as licences, top.name as licence, coalesce(f.dice, 0)::double as dice, coalesce(f.n, 0) as n_matches from d left join f using (doc_id) left join top using (doc_id)"""

OP3 = rf"""with w as (select doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '{_SPACE}'), lambda x: x <> '') as words from documents),
 s as (select doc_id, list_distinct(case when len(words) >= 3 then list_transform(range(1, len(words) - 1), lambda i: words[i] || ' ' || words[i + 1] || ' ' || words[i + 2]) when len(words) > 0 then [array_to_string(words, ' ')] else [] end) as grams from w),
 u as (select doc_id, len(grams) as n, unnest(grams) as gram from s),
 common as (select a.doc_id as a, b.doc_id as b, any_value(a.n) as na, any_value(b.n) as nb, count(*) as c from u a join u b on a.gram = b.gram and a.doc_id < b.doc_id group by a.doc_id, b.doc_id),
 link as (select a, b from common where 100 * c >= 85 * (na + nb - c)),
 sides as (select a, b from link union select b, a from link),
 reach as (with recursive r(id, other) as (select doc_id, doc_id from documents union select r.id, sides.b from r join sides on r.other = sides.a) select id, min(other) as component_id from r group by id)
 select s.doc_id, len(grams) as n_shingles, component_id, s.doc_id = component_id as kept from s join reach on s.doc_id = reach.id"""

OP5 = r"""with t as (select conv_id, turn, role, coalesce(text, '') as text from conversations union all values (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')),
 f as (select *, length(text) + length(regexp_replace(text, '[^\\\[<]+', '', 'g')) + case role when 'system' then 11 when 'assistant' then 10 else 13 end as n from t)
 select conv_id, count(*) as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn)) as turns_sha256, length(coalesce(string_agg(text, '' order by turn) filter (role = 'assistant'), '')) as loss_chars,
 sha256(coalesce(string_agg(text, '' order by turn) filter (role = 'assistant'), '')) as loss_sha256, cast(sum(n) as bigint) as formatted_chars from f group by conv_id"""

OP7 = """with l as (select doc_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as k from documents),
 d as (select line, min(struct_pack(doc_id := doc_id, k := k)) as first from l where regexp_matches(line, '[^\\x20\\x09-\\x0D]') group by line),
 n as (select line, first, length(line) as n from d where length(line) >= 20),
 gone as (select b.line from n a join n b on a.n = b.n and a.first < b.first where levenshtein(a.line, b.line) = 1 union select b.line from n a join n b on a.n = b.n + 1 and a.first < b.first where levenshtein(a.line, b.line) = 1 union select b.line from n a join n b on a.n = b.n - 1 and a.first < b.first where levenshtein(a.line, b.line) = 1),
 m as (select l.doc_id, l.k, l.line, d.line is not null and (gone.line is not null or struct_pack(doc_id := l.doc_id, k := l.k) <> d.first) as dropped from l left join d on l.line = d.line left join gone on l.line = gone.line)
 select doc_id, count(*) as n_lines, count(*) filter (dropped) as n_dropped, length(coalesce(string_agg(line, chr(10) order by k) filter (not dropped), '')) as clean_chars, sha256(coalesce(string_agg(line, chr(10) order by k) filter (not dropped), '')) as clean_sha256 from m group by doc_id"""

OP9 = rf"""with w as (select doc_id, coalesce(text, '') as text, list_filter(string_split_regex(coalesce(text, ''), '{_SPACE}'), lambda x: x <> '') as words, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as lines from documents),
 v as (select doc_id, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] as win from (select doc_id, words, unnest(range(1, len(words) - 1)) as i from w)),
 r as (select doc_id, count(distinct p) as n from (select doc_id, unnest([i, i + 1, i + 2]) as p from (select *, count(*) over (partition by doc_id, win) as c from v) where c > 1) group by doc_id),
 b as (select w.doc_id, w.text, words, len(words) as n_words, length(array_to_string(words, '')) as word_chars, length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g')) as n_symbols, len(lines) - len(list_distinct(lines)) as n_dup_lines, len(lines) as n_lines, coalesce(r.n, 0) as n_repeat_words from w left join r using (doc_id)),
 f as (select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed from b)
 select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, not base_failed and word_chars >= 2 * n_words and word_chars <= 14 * n_words and not n_symbols > 0.1 * n_words and not n_dup_lines > 0.4 * n_lines
 and not length(regexp_replace(text, '\P{{Lu}}+', '', 'g')) > 0.4 * word_chars and not len(list_filter(words, lambda x: not regexp_matches(x, '\p{{L}}'))) > 0.3 * n_words as kept from f"""

OP11 = """with v as (select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label, list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as bigint)) as x
  from embeddings where label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
 s as (select a.vec_id as a, b.vec_id as b, a.label = b.label as same, cast(list_inner_product(cast(a.x as double[]), cast(b.x as double[])) as bigint) as score from v a join v b on a.vec_id % 100 = 0 and a.vec_id <> b.vec_id),
 p as (select a, b, score from s where same qualify row_number() over (partition by a order by score desc, b) <= 5),
 w as (select p.a as anchor_id, p.b as positive_id, p.score as positive_score, s.b as negative_id, s.score as negative_score, row_number() over (partition by p.a, p.b order by s.score desc, s.b) as rank
  from p join s on p.a = s.a where not s.same and 30 * p.score <= 100 * s.score and 100 * s.score <= 90 * p.score)
 select anchor_id, positive_id, cast(rank as int) as rank, negative_id, positive_score, negative_score from w where rank <= 10"""

_FLOOR = "(s - ((s % n) + n) % n) // n"


def _op13(k: int = 16, rounds: int = 3) -> str:
    """The rounds one after the other: a0, c1, a1, ..., each centroid as a list of whole numbers."""
    nearest = "select vec_id, x, i, d from (select v.vec_id, v.row, v.x, c.i, cast(list_sum(list_transform(list_zip(v.x, c.x), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) as bigint) as d from v, c{r} c) qualify row_number() over (partition by row order by d, i) = 1"
    moved = f"select c.i, coalesce(m.x, c.x) as x from c{{r}} c left join (select i, list(cast({_FLOOR} as bigint) order by j) as x from (select i, j, sum(y) as s, count(*) as n from (select i, unnest(x) as y, generate_subscripts(x, 1) as j from a{{r}}) group by i, j) group by i) m on c.i = m.i"
    steps = [step for r in range(rounds) for step in (f"a{r} as materialized ({nearest.format(r=r)})", f"c{r + 1} as materialized ({moved.format(r=r)})")]
    return f"""with v as materialized (select row_number() over () as row, vec_id, list_transform(embedding, lambda x: cast(floor(64 * cast(x as double)) as bigint)) as x from embeddings where len(embedding) = 64 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
 c0 as materialized (select row_number() over (order by sha256('1:' || vec_id), x) - 1 as i, x from v qualify i < {k}),
 {", ".join(steps)}, a as ({nearest.format(r=rounds)})
 select vec_id, cast(a.i as int) as cluster, d as distance, cast(sum(d) over (partition by a.i) as bigint) as cluster_inertia, cast(sum(d) over () as bigint) as inertia, sha256(array_to_string(c{rounds}.x, ',')) as centroid_sha256 from a join c{rounds} using (i)"""


ORACLES = {"op1_licences": OP1, "op3_neardup": OP3, "op5_chat": OP5, "op7_line_dedup": OP7, "op9_quality_rules": OP9, "op11_hard_negatives": OP11, "op13_clusters": _op13()}
