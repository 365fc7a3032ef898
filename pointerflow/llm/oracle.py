"""DuckDB SQL for the corpus queries that SQL can express."""

from __future__ import annotations

_LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

COLLOCATIONS = rf"""
with texts as (
  select coalesce(lang, 'und') as lang, translate(coalesce(text, ''), '{_LETTERS}', '{_LETTERS.lower()}') as t from documents
), pieces as (
  select lang, unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')) as piece from texts
), words as (
  select lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda w: w <> '') as w from pieces
), places as (
  select lang, w, unnest(range(1, len(w) + 1)) as i from words
), grams as (
  select lang, m, array_to_string(w[i:i + m - 1], ' ') as phrase
  from places, (select unnest(range(1, 6)) as m) where i + m - 1 <= len(w)
), totals as (
  select lang, count(*) as n from grams where m = 1 group by lang
), counts as (
  select lang, m, phrase, count(*) as a from grams group by lang, m, phrase having count(*) >= 100
), cuts as (
  select lang, m, phrase, a, string_split(phrase, ' ') as w, unnest(range(1, m)) as k from counts where m > 1
), scored as (
  select c.lang, c.phrase, c.a, c.k, l.a as l, r.a as r, t.n,
    (1000::hugeint * c.a * t.n) // (l.a::hugeint * r.a) as score
  from cuts c join totals t on t.lang = c.lang
  join counts l on l.lang = c.lang and l.phrase = array_to_string(c.w[1:c.k], ' ')
  join counts r on r.lang = c.lang and r.phrase = array_to_string(c.w[c.k + 1:c.m], ' ')
), lowest as (
  select * from scored qualify row_number() over (partition by lang, phrase order by score, k) = 1
), inner_phrases as (
  select lang, a, unnest(flatten(list_transform(range(2, m), lambda x: list_transform(range(1, m - x + 2), lambda i: array_to_string(w[i:i + x - 1], ' '))))) as phrase
  from (select distinct lang, m, a, w from cuts where m > 2)
), covered as (
  select c.lang, c.phrase from counts c join inner_phrases p on p.lang = c.lang and p.phrase = c.phrase and p.a >= c.a
)
select lang, row_number() over (partition by lang order by score desc, a desc, phrase) as rank, phrase, a,
  l, r, n, cast(score as bigint) as score
from lowest where (lang, phrase) not in (select (lang, phrase) from covered)
qualify rank <= 2000
"""


def _centroids(rounds: int = 5, k: int = 40) -> str:
    steps = [
        rf"""kept as materialized (
  select row_number() over () as row, vec_id, list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as bigint)) as v
  from embeddings
  where len(embedding) = 64 and len(list_filter(embedding, lambda x: x is not null and isfinite(x))) = 64
), c0 as materialized (
  select row_number() over (order by sha256('2:' || vec_id), v) - 1 as c, v from kept
  qualify row_number() over (order by sha256('2:' || vec_id), v) <= {k}
)"""
    ]
    for r in range(rounds + 1):
        steps.append(f"""d{r} as materialized (
  select k.row, k.vec_id, k.v, c.c as c,
    cast(list_sum(list_transform(range(1, 65), lambda i: (k.v[i] - c.v[i]) * (k.v[i] - c.v[i]))) as bigint) as d
  from kept k, c{r} c
), a{r} as materialized (
  select * from d{r} qualify row_number() over (partition by row order by d, c) = 1
)""")
        if r < rounds:
            steps.append(f"""c{r + 1} as materialized (
  with sums as (
    select c, i, cast(sum(v[i]) as bigint) as s, count(*) as n from a{r}, (select unnest(range(1, 65)) as i) group by c, i
  ), moved as (
    select c, list((s - ((s % n) + n) % n) // n order by i) as v from sums group by c
  )
  select o.c, coalesce(m.v, o.v) as v from c{r} o left join moved m on m.c = o.c
)""")
    return f"""with {", ".join(steps)}
select a.vec_id, cast(a.c as integer) as cluster, a.d as distance,
  cast(sum(a.d) over (partition by a.c) as bigint) as cluster_inertia, cast(sum(a.d) over () as bigint) as inertia,
  sha256(array_to_string(c.v, ',')) as centroid_sha256
from a{rounds} a join c{rounds} c on c.c = a.c
"""


CENTROIDS = _centroids()
