"""DuckDB SQL for the operators whose results SQL can express on whole tables (doc_id names a document there)."""

from __future__ import annotations

from terrane.llm.license_scan import COVER, K, LOWER, NEAR, SPLIT, UPPER, listed
from terrane.llm.license_texts import BASE, NOTICES, TEXTS

_grams = [f"({n}, '{label}', {str(base).lower()}, {len(w) - K + 1}, {j}, '{' '.join(w[j : j + K])}')" for n, label, base, w in listed(BASE, NOTICES, TEXTS) for j in range(len(w) - K + 1)]
LICENSES = f"""with t(template, label, is_base, size, j, gram) as (values {', '.join(_grams)}),
d as (select doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{SPLIT}'), lambda x: x <> '') as w from documents),
g as (select doc_id, unnest(list_transform(range(1, len(w) - {K - 2}), lambda i: struct_pack(i := i - 1, gram := array_to_string(w[i:i + {K - 1}], ' ')))) as x from d),
votes as (select doc_id, template, label, is_base, size, x.i - j as diagonal, list(distinct j) as seen, min(x.i) as first, max(x.i) as last from g join t on x.gram = t.gram group by all),
gaps as (select *, case when is_base or coalesce(diagonal - lag(diagonal) over (partition by doc_id, template order by diagonal) > {NEAR}, true) then 1 else 0 end as fresh from votes),
runs as (select *, sum(fresh) over (partition by doc_id, template order by diagonal rows unbounded preceding) as run from gaps),
merged as (select doc_id, label, is_base, min(first) as first, len(list_distinct(flatten(list(seen)))) / max(size) as cover from runs group by doc_id, template, label, is_base, run),
good as (select * from merged where cover >= case when is_base then 1.0 else {COVER} end),
found as (select doc_id, count(*) filter (where is_base) as n_base, min(first) filter (where is_base) as first_word, max(first) filter (where is_base) as last_word,
  string_agg(distinct label, ',' order by label) filter (where is_base) as base_labels, string_agg(distinct label, ',' order by label) as labels from good group by 1),
best as (select doc_id, max(cover) as score from merged group by 1)
select doc_id, cast(len(w) as bigint) as n_words, coalesce(n_base, 0) as n_base, cast(first_word as bigint) as first_word, cast(last_word as bigint) as last_word,
  coalesce(base_labels, '') as base_labels, coalesce(labels, '') as labels, coalesce(score, 0.0)::double as score from d left join found using (doc_id) left join best using (doc_id)"""

JACCARD = f"""with recursive d as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\\x20\\x09-\\x0D]+') as w from documents),
s as (select distinct doc_id, unnest(case when len(w) >= 5 then list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) when len(w) > 0 then [array_to_string(w, ' ') || ' '] else [] end) as x from d),
n as (select doc_id, count(*) as n from s group by 1),
shared as (select a.doc_id as a, b.doc_id as b, count(*) as m from s a join s b on a.x = b.x and a.doc_id < b.doc_id group by 1, 2),
links as (select a, b from shared join n p on p.doc_id = a join n q on q.doc_id = b where 100 * m >= 80 * (p.n + q.n - m)),
ways as (select a, b from links union all select b, a from links),
reach(doc_id, other) as (select doc_id, doc_id from d union select reach.doc_id, ways.b from reach join ways on ways.a = reach.other)
select doc_id, coalesce(max(n.n), 0) as n_shingles, min(other) as component_id from reach left join n using (doc_id) group by 1"""

REPEATS = """with d as (select doc_id, hex(encode(coalesce(text, ''))) as h, octet_length(encode(coalesce(text, ''))) as n from documents),
win as (select doc_id, i, hash(substr(h, 2 * i + 1, 400)) as k, md5(substr(h, 2 * i + 1, 400)) as m from (select doc_id, h, unnest(range(0, n - 199)) as i from d)),
again as (select k, m from win group by 1, 2 having count(*) > 1),
hit as (select doc_id, i, lag(i) over (partition by doc_id order by i) as before from win join again using (k, m)),
runs as (select doc_id, i, sum(case when before is null or i > before + 200 then 1 else 0 end) over (partition by doc_id order by i) as run from hit),
spans as (select doc_id, run, min(i) as a, max(i) + 200 as b from runs group by 1, 2),
cuts as (select doc_id, a, b, coalesce(lag(b) over (partition by doc_id order by a), 0) as start, row_number() over (partition by doc_id order by a desc) as place from spans),
pieces as (select doc_id, start as a, a as b from cuts union all select doc_id, b, n from cuts join d using (doc_id) where place = 1 union all select doc_id, 0, n from d where doc_id not in (select doc_id from spans)),
kept as (select doc_id, string_agg(substr(h, 2 * a + 1, 2 * (b - a)), '' order by a) as h from pieces join d using (doc_id) group by 1)
select d.doc_id, d.n as n_bytes, coalesce(r.removed, 0)::bigint as n_removed, coalesce(r.spans, 0) as n_spans, sha256(unhex(coalesce(kept.h, ''))) as kept_sha256
from d left join kept using (doc_id) left join (select doc_id, sum(b - a) as removed, count(*) as spans from spans group by 1) r using (doc_id)"""

SQL = {"op5_suffix_dedup": REPEATS, "op9_jaccard_join": JACCARD, "op10_license_scan": LICENSES}
