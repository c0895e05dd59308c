"""DuckDB SQL with the meaning of each registered query, written from the definitions: plain windows,
COUNT(DISTINCT), RANK() and self-joins where the Spark side uses other forms."""

from __future__ import annotations

import re

TYPES = ("clicks", "carts", "orders")
DAYS = range(1, 8)
SLOTS = (
    "covisit_clicks", "covisit_carts", "covisit_orders", "vector_vote", "transition", "last_item",
)
STEPS = (("clicks", "carts"), ("carts", "orders"))
RATIOS = (("clicks", "carts"), ("carts", "orders"), ("clicks", "orders"))
WEIGHT = {"clicks": 0.07197733833680556, "carts": 0.708280136807459, "orders": 0.05318170583899917}
RECENCY = (
    "action_num_reverse_chrono", "sec_since_session_start", "sec_to_session_end",
    "log_recency_score", "type_weighted_log_recency_score",
)

CTE: dict[str, str] = {}

CTE["ev"] = """
select (user_id * 10 + day // 10)::bigint as session, aid, ts, type, day from (
  select user_id,
    case event_type when 'view' then 'clicks' when 'click' then 'clicks'
                    when 'signup' then 'carts' when 'purchase' then 'orders' end as type,
    cast(json_extract_string(props, '$.k') as bigint) as aid,
    epoch_us(ts) // 1000 as ts,
    cast(datediff('day', date '2024-01-01', cast(ts + interval 2 hours as date)) as bigint) as day
  from events where event_type <> 'error') e
"""
CTE["train"] = "select session, aid, ts, type from ev where day not between 27 and 29"
CTE["test"] = "select session, aid, ts, type from ev where day between 20 and 26"
CTE["truth"] = "select distinct session, type, aid from ev where day between 27 and 29"
CTE["baskets"] = """
select o_custkey as session, l_partkey as aid, epoch_us(l_shipdate) // 1000 as ts,
  case l_returnflag when 'N' then 'clicks' when 'A' then 'carts' when 'R' then 'orders' end as type
from lineitem join orders on l_orderkey = o_orderkey
"""
CTE["vec"] = "select vec_id as aid, embedding::double[] as vector from embeddings"
CTE["test_dt"] = "select *, cast(make_timestamp(ts * 1000) + interval 2 hours as date) as dt from test"
CTE["days"] = "select dt, row_number() over (order by dt) as num from (select distinct dt from test_dt)"
CTE["tn"] = "select t.*, d.num from test_dt t join days d on t.dt = d.dt"


def _tail(source: str, where: str = "true") -> str:
    return f"""
select session, aid, ts, type, n from (
  select *, row_number() over (partition by session order by ts desc, aid desc, type desc) as n
  from {source} where {where}) where n <= 30
"""


CTE["tail"] = _tail("train")
CTE["tail_buy"] = _tail("train", "type in ('carts', 'orders')")
CTE["tail_baskets"] = _tail("baskets")


def _near(tail: str, seconds: int) -> str:
    return f"""{tail} x join {tail} y on x.session = y.session and x.aid <> y.aid
    and abs(x.ts // 1000 - y.ts // 1000) < {seconds}"""


def _best(weights: str) -> str:
    return f"""
select aid_x, aid_y, wgt, n from (
  select *, row_number() over (partition by aid_x order by wgt desc, aid_y) as n from (
{weights})) where n <= 15
"""


def _decayed(tail: str, source: str, seconds: int) -> str:
    return _best(f"""
    select aid_x, aid_y, round(sum(1 + 3 * (ts_x - t0)::double / (t1 - t0)), 6) as wgt from (
      select x.session, x.aid as aid_x, y.aid as aid_y, max(x.ts // 1000) as ts_x
      from {_near(tail, seconds)} group by 1, 2, 3) p,
      (select min(ts // 1000) as t0, max(ts // 1000) as t1 from {source}) s
    group by 1, 2""")


CTE["cov_clicks"] = _decayed("tail", "train", 86400)
CTE["cov_baskets"] = _decayed("tail_baskets", "baskets", 90 * 86400)
_case = " ".join(f"when '{t}' then {w!r}::double" for t, w in WEIGHT.items())
CTE["cov_buys"] = _best(f"""
    select aid_x, aid_y, round(sum(case type_y {_case} end), 6) as wgt from (
      select distinct x.session, x.aid as aid_x, y.aid as aid_y, y.type as type_y
      from {_near('tail', 86400)}) group by 1, 2""")
CTE["cov_b2b"] = _best(f"""
    select aid_x, aid_y, round(count(*)::double, 6) as wgt from (
      select distinct x.session, x.aid as aid_x, y.aid as aid_y, y.type as type_y
      from {_near('tail_buy', 14 * 86400)}) group by 1, 2""")

CTE["seen"] = """
select session, aid, last_ts, row_number() over (partition by session order by last_ts desc, aid desc) as position
from (select session, aid, max(ts) as last_ts from test group by 1, 2)
"""
CTE["bought"] = """
select session, aid, row_number() over (partition by session order by last_ts desc, aid desc) as position
from (select session, aid, max(ts) as last_ts from test where type in ('carts', 'orders') group by 1, 2)
"""


def _voted(votes: str, k: int = 100) -> str:
    return f"""
select session, aid, rank from (
  select session, aid, row_number() over (partition by session order by cnt desc, walk) as rank from (
    select session, aid, count(*) as cnt, min(walk) as walk from (
      {votes}) group by 1, 2)) where rank <= {k}
"""


def _walk(seen: str, nbrs: str, source: int = 0) -> str:
    return f"""select h.session, n.aid_y as aid, {source} * 1000000000 + h.position * 1000 + n.n as walk
      from {seen} h join {nbrs} n on h.aid = n.aid_x"""


CTE["sug_clicks"] = _voted(_walk("seen", "cov_clicks"))
CTE["sug_buys"] = _voted(_walk("seen", "cov_buys") + "\n      union all\n      " + _walk("bought", "cov_b2b", 1))
CTE["typed"] = """
select session, 'clicks' as type, aid, rank from sug_clicks
union all select session, 'carts' as type, aid, rank from sug_buys
union all select session, 'orders' as type, aid, rank from sug_buys
"""
CTE["knn"] = """
select aid_x, aid_y, dist, n from (
  select *, row_number() over (partition by aid_x order by dist, aid_y) as n from (
    select a.aid as aid_x, b.aid as aid_y, round(sqrt(greatest(0.0, round(2 * (1 -
        list_dot_product(a.vector, b.vector)
        / sqrt(list_dot_product(a.vector, a.vector)) / sqrt(list_dot_product(b.vector, b.vector))), 12))), 6) as dist
    from vec a, vec b)) where n <= 20
"""
CTE["planes"] = """
select t, b, list(case when ('0x' || substr(md5(concat_ws(':', 7, t, b, d)), 1, 1))::bigint % 2 = 0 then 1.0 else -1.0 end::double
    order by d) as plane
from range(12) x(t), range((select greatest(1, ceil(log2(count(*) / 256.0)))::bigint from vec)) y(b), range(64) z(d) group by 1, 2
"""
CTE["codes"] = """
select aid, t, sum(case when list_dot_product(vector, plane) > 0 then 1 << b::int else 0 end) as code
from vec cross join planes group by 1, 2
"""
CTE["lsh"] = """
select aid_x, aid_y, dist, n from (
  select *, row_number() over (partition by aid_x order by dist, aid_y) as n from (
    select p.x as aid_x, p.y as aid_y, round(sqrt(greatest(0.0, round(2 * (1 -
        list_dot_product(a.vector, b.vector)
        / sqrt(list_dot_product(a.vector, a.vector)) / sqrt(list_dot_product(b.vector, b.vector))), 12))), 6) as dist
    from (select distinct k.aid as x, l.aid as y from codes k join codes l on k.t = l.t and k.code = l.code) p
    join vec a on a.aid = p.x join vec b on b.aid = p.y)) where n <= 20
"""
CTE["knn_votes"] = _voted(_walk("seen", "knn"))
CTE["newest"] = """
select session, aid from (
  select *, row_number() over (partition by session order by ts desc, aid desc, type desc) as n from test) where n = 1
"""
CTE["last_near"] = "select h.session, k.aid_y as aid, k.n as rank from newest h join knn k on h.aid = k.aid_x"
CTE["moves"] = """
select * from (
  select session, ts, row_number() over w - 1 as pos, aid, lead(aid) over w as aid_next
  from train window w as (partition by session order by ts, aid, type)) where aid_next is not null
"""
CTE["model"] = """
select aid, aid_next, p from (
  select aid, aid_next, c::double / sum(c) over (partition by aid) as p
  from (select aid, aid_next, count(*) as c from moves group by 1, 2))
"""
CTE["seq_tail"] = """
select session, aid, back from (
  select session, aid, row_number() over (partition by session order by first_ts desc, aid desc) as back
  from (select session, aid, min(ts) as first_ts from test group by 1, 2)) where back <= 20
"""
CTE["seq"] = """
select session, aid, rank from (
  select session, aid_next as aid, row_number() over (partition by session order by score desc, aid_next) as rank
  from (select session, aid_next, round(sum(p / back), 6) as score
        from seq_tail join model using (aid) group by 1, 2)) where rank <= 100
"""

_counts = ",\n  ".join(f"count(*) filter (type = '{t}') as {t}_cnt" for t in TYPES)
_uu = ",\n  ".join(f"count(distinct case when type = '{t}' then session end) as {t}_uu" for t in TYPES)
_ranks = ",\n  ".join(
    f"rank() over ({{part}} order by {t}_{s} desc) as {t}_{'rank' if s == 'cnt' else 'uu_rank'}"
    for s in ("cnt", "uu")
    for t in TYPES
)


def _funnel(key: str, prefix: str) -> str:
    aggs = ", ".join(
        (f"round({f}(g_{a}_{b}), 6)" if f == "avg" else f"{f}(g_{a}_{b})") + f" as {f}_sec_{prefix}{a}_{b}"
        for a, b in STEPS
        for f in ("avg", "min", "max")
    )
    gaps = ", ".join(f"case when f_{b} - f_{a} > 0 then f_{b} - f_{a} end as g_{a}_{b}" for a, b in STEPS)
    firsts = ", ".join(f"min(case when type = '{t}' then ts end) as f_{t}" for t in TYPES)
    return f"""
select {key}, {aggs} from (
  select session, aid, {gaps} from (
    select session, aid, {firsts} from test group by 1, 2)) group by 1
"""


def _day_counts(prefix: str) -> str:
    return ",\n  ".join(
        f"count(*) filter (type = '{t}' and num = {d}) as {prefix}{t}_cnt_day{d}" for t in TYPES for d in DAYS
    )


CTE["s_funnel"] = _funnel("session", "session_")
CTE["i_funnel"] = _funnel("aid", "")
CTE["s_days"] = f"select session, {_day_counts('session_')} from tn group by 1"
_s_cnt = ", ".join(f"count(*) filter (type = '{t}') as session_{t}_cnt" for t in TYPES)
_s_unique = ", ".join(
    f"count(distinct case when type = '{t}' then aid end) as session_{t}_unique_aid" for t in TYPES
)
_s_ratio = ", ".join(
    f"case when session_{a}_unique_aid <> 0 then round(session_{b}_unique_aid::double / session_{a}_unique_aid, 6) end"
    f" as session_{a}_{b}_ratio"
    for a, b in RATIOS
)
CTE["s_stats"] = f"""
select *, {_s_ratio} from (
  select session, min(num) as min_day_num, max(num) as max_day_num, {_s_cnt}, {_s_unique} from tn group by 1)
join s_days using (session) join s_funnel using (session)
"""
CTE["i_counts"] = f"select aid, {_counts}, {_uu} from test group by 1"
_i_avg = ", ".join(
    f"case when {t}_uu = 0 then 0.0::double else round({t}_cnt::double / {t}_uu, 6) end as avg_{t}_cnt" for t in TYPES
)
_i_ratio = ", ".join(
    f"case when {a}_uu <> 0 then round({b}_uu::double / {a}_uu, 6) end as {a}_{b}_ratio" for a, b in RATIOS
)
CTE["i_daily"] = f"""
select dt, num as day_num, aid, {_ranks.format(part='partition by dt')}
from (select dt, num, aid, {_counts}, {_uu} from tn group by 1, 2, 3)
"""
_i_day = ", ".join(
    f"max(case when day_num = {d} then {t}_rank end) as {t}_rank_day{d}" for t in TYPES for d in DAYS
)
CTE["i_by_day"] = f"select aid, {_i_day} from i_daily group by 1"
CTE["i_stats"] = f"""
select * from (select aid, {_ranks.format(part='')}, {_i_avg}, {_i_ratio} from i_counts)
join i_funnel using (aid) join i_by_day using (aid)
"""


def _recency(source: str) -> str:
    return f"""
select *, case type when 'clicks' then 1 when 'carts' then 6 else 3 end * log_recency_score
    as type_weighted_log_recency_score from (
  select *, case when session_interaction_length = 1 then 1.0::double else
    pow(2::double, 0.1::double + 0.9::double / (session_interaction_length - 1)
      * (session_interaction_length - action_num_reverse_chrono - 1)) - 1 end as log_recency_score from (
    select session, aid, ts, type,
      row_number() over (partition by session order by ts desc, aid desc, type desc) - 1 as action_num_reverse_chrono,
      ts - min(ts) over (partition by session) as sec_since_session_start,
      max(ts) over (partition by session) - ts as sec_to_session_end,
      count(*) over (partition by session) as session_interaction_length
    from {source}))
"""


CTE["recency"] = _recency("test")
CTE["recency_baskets"] = _recency("baskets")
_rec = ", ".join(
    (f"round({f}({m}), 6)" if f == "avg" or m.endswith("_score") else f"{f}({m})") + f" as {f}_{m}"
    for m in RECENCY
    for f in ("avg", "min", "max")
)
_sa_cnt = ", ".join(f"count(*) filter (type = '{t}') as session_aid_{t}_cnt" for t in TYPES)
CTE["si_stats"] = f"""
select session, aid, {_rec}, {_sa_cnt}, {_day_counts('session_aid_')}
from (select r.*, d.num from
  (select *, cast(make_timestamp(ts * 1000) + interval 2 hours as date) as dt from recency) r
  join days d on r.dt = d.dt) group by 1, 2
"""
CTE["sold"] = "select num, aid, count(*) as sold from tn where type = 'orders' group by 1, 2"
CTE["popular_items"] = """
select aid from (select *, row_number() over (partition by num order by sold desc, aid) as n from sold where num <= 7)
where n <= 20
union
select aid from (select aid, row_number() over (order by sum(sold) desc, aid) as n from sold group by 1) where n <= 20
"""
CTE["popular"] = "select session, aid from (select distinct session from test) cross join popular_items"


def _slot(source: str, slot: str, where: str = "true") -> str:
    return f"select session, aid, '{slot}' as slot, rank from {source} where {where}"


CTE["tall"] = "\nunion all ".join(
    [
        "select session, aid, 'covisit_' || type as slot, rank from typed",
        _slot("knn_votes", "vector_vote"),
        _slot("seq", "transition"),
        _slot("last_near", "last_item"),
        "select session, aid, null as slot, null as rank from popular",
        "select distinct session, aid, null as slot, null as rank from test",
    ]
)
_slots = ", ".join(f"max(case when slot = '{s}' then rank end)::bigint as {s}_candidate_num" for s in SLOTS)
CTE["merged"] = f"select session, aid, {_slots} from tall group by 1, 2"
CTE["unioned"] = "select * from merged left join si_stats using (session, aid)"


def _feature_columns() -> str:
    cols = ["min_day_num", "max_day_num"]
    cols += [f"coalesce(session_{t}_cnt_day{d}, 0) as session_{t}_cnt_day{d}" for t in TYPES for d in DAYS]
    cols += [f"session_{t}_{x}" for x in ("cnt", "unique_aid") for t in TYPES]
    cols += [f"session_{a}_{b}_ratio" for a, b in RATIOS]
    cols += [f"{f}_sec_session_{a}_{b}" for a, b in STEPS for f in ("avg", "min", "max")]
    cols += [f"coalesce(session_aid_{t}_cnt, 0) as session_aid_{t}_cnt" for t in TYPES]
    cols += [f"{f}_{m}" for m in RECENCY for f in ("avg", "min", "max")]
    cols += [f"coalesce(session_aid_{t}_cnt_day{d}, 0) as session_aid_{t}_cnt_day{d}" for t in TYPES for d in DAYS]
    cols += [f"{s}_candidate_num" for s in SLOTS]
    cols += [f"coalesce({t}_{r}, 1000000) as {t}_{r}" for r in ("rank", "uu_rank") for t in TYPES]
    cols += [f"coalesce(avg_{t}_cnt, 0) as avg_{t}_cnt" for t in TYPES]
    cols += [f"{a}_{b}_ratio" for a, b in RATIOS]
    cols += [f"{f}_sec_{a}_{b}" for a, b in STEPS for f in ("avg", "min", "max")]
    cols += [f"coalesce({t}_rank_day{d}, 1000000) as {t}_rank_day{d}" for t in TYPES for d in DAYS]
    assert len(cols) == 122
    return ", ".join(cols)


CTE["feats"] = f"""
select session, aid, {_feature_columns()}
from unioned left join s_stats using (session) left join i_stats using (aid)
"""


def _distances(candidates: str) -> str:
    return f"""
select session, aid, round(avg(d), 6) as score_mean, round(stddev_pop(d), 6) as score_std,
  round(max(d), 6) as score_max, round(min(d), 6) as score_min, count(*) as score_length from (
  select c.session, c.aid, sqrt(greatest(0.0, round(2 * (1 - list_dot_product(a.vector, b.vector)
        / sqrt(list_dot_product(a.vector, a.vector)) / sqrt(list_dot_product(b.vector, b.vector))), 12))) as d
  from (select distinct session, aid from {candidates}) c join test h on c.session = h.session
  join vec a on c.aid = a.aid join vec b on h.aid = b.aid) group by 1, 2
"""


CTE["joined"] = """
select c.session, c.aid, t.type from merged c left join truth t on t.session = c.session and t.aid = c.aid
"""
CTE["labeled"] = """
select c.session, c.aid, (t.aid is not null)::bigint as gt
from merged c left join (select * from truth where type = 'clicks') t on t.session = c.session and t.aid = c.aid
"""


def _hash(*ids: str, seed: int = 0) -> str:
    return f"('0x' || substr(md5(concat_ws(':', {seed}, {', '.join(ids)})), 1, 15))::bigint"


def _targets(type_: str) -> str:
    counts = ", ".join(f"count(*) filter (type = '{t}') as {t}_cnt" for t in TYPES)
    return f"""
select * from (select session, {counts} from joined where type is not null group by 1) where {type_}_cnt > 0
"""


def _negatives(type_: str) -> str:
    return f"""
select session, aid from (
  select j.session, j.aid, {type_}_cnt,
    row_number() over (partition by j.session order by {_hash('j.session', 'j.aid')}, j.aid) as rn
  from joined j join tgt_{type_} h on h.session = j.session where j.type is null) where rn <= 20 * {type_}_cnt
"""


def _positives(type_: str) -> str:
    return f"""
select session, aid from joined where type = '{type_}' and session in (select session from tgt_{type_})
"""


for _t in TYPES:
    CTE[f"tgt_{_t}"] = _targets(_t)
    CTE[f"neg_{_t}"] = _negatives(_t)
    CTE[f"pos_{_t}"] = _positives(_t)

CTE["hits"] = "select p.session, p.type, p.aid, p.rank from typed p join truth using (session, type, aid)"
CTE["gt"] = "select session, type, count(*) as n, least(count(*), 20) as gt_count from truth group by 1, 2"
CTE["recall_rows"] = """
select g.type, k.k, coalesce(sum(h.hits), 0)::bigint as hits, sum(g.gt_count)::bigint as gt_count,
  round(coalesce(sum(h.hits), 0)::double / sum(g.gt_count), 6) as recall
from gt g cross join (select unnest([20, 100])::bigint as k) k
left join (select session, type, k2.k, count(*) as hits from hits, (select unnest([20, 100])::bigint as k) k2
           where rank <= k2.k group by 1, 2, 3) h
  on h.session = g.session and h.type = g.type and h.k = k.k
group by 1, 2
"""
_weights = "case type when 'clicks' then 0.1::double when 'carts' then 0.3::double else 0.6::double end"
CTE["recall_sum"] = f"select k, round(sum({_weights} * recall), 6) as total from recall_rows group by 1"
CTE["by_session"] = """
select g.session, g.type, g.gt_count, coalesce(h.hits, 0) as hits, round(coalesce(h.hits, 0)::double / gt_count, 6) as recall
from gt g left join (select session, type, count(*) as hits from hits where rank <= 20 group by 1, 2) h
  using (session, type)
"""
CTE["fold_scores"] = f"""
select session, aid, type, fold, round(1.0::double / rank + ({_hash('session', 'aid', 'fold')} % 1000003) / 1e6::double, 6) as score
from typed, (select unnest(range(5)) as fold)
"""
CTE["mean_scores"] = """
select session, aid, type, round(avg(score), 6) as score from fold_scores group by 1, 2, 3
"""
CTE["hashed"] = f"select *, {_hash('session', 'pos')} as h from moves"
CTE["wrong"] = """
select *, coalesce(lead(aid_next) over w, first_value(aid_next) over w) as aid_wrong
from (select *, (row_number() over (order by h, session, pos) - 1) // 500 as batch from hashed)
window w as (partition by batch order by h, session, pos)
"""

FINAL: dict[str, str] = {
    "interactions": """
select session, aid, ts, type, ts // 1000 as ts_s,
  case type when 'clicks' then 0 when 'carts' then 1 else 2 end::bigint as type_code,
  make_timestamp(ts * 1000) as event_time, cast(make_timestamp(ts * 1000) + interval 2 hours as date) as dt
from ev""",
    "session_items": "select session, aid from test",
    "labels_long": "select session, type, aid from truth",
    "day_num": "select dt, num from days",
    "session_sequences": """
select session, aid, row_number() over (partition by session order by ts, aid, type) - 1 as pos from baskets""",
    "recent_unique_items": "select session, aid, last_ts, position from seen",
    "session_tail": "select * from tail",
    "session_tail_baskets": "select * from tail_baskets",
    "covisit_clicks": "select * from cov_clicks",
    "covisit_by_increments": "select * from cov_clicks",
    "covisit_carts_orders": "select * from cov_buys",
    "covisit_buy2buy": "select * from cov_b2b",
    "covisit_clicks_baskets": "select * from cov_baskets",
    "suggest_clicks": "select * from sug_clicks",
    "suggest_buys": "select * from sug_buys",
    "candidates_by_type": "select * from typed",
    "popular_candidates": "select * from popular",
    "list_candidates": "select * from sug_clicks",
    "covisit_rank_pivot": "select session, aid, "
    + ", ".join(f"max(case when type = '{t}' then rank end) as covisit_{t}_candidate_num" for t in TYPES)
    + " from typed group by 1, 2",
    "knn_vote_candidates": "select * from knn_votes",
    "last_item_candidates": "select * from last_near",
    "sequence_candidates": "select * from seq",
    "candidate_union": "select * from unioned",
    "session_day_counts": "select * from s_days",
    "session_stats": "select * from s_stats",
    "session_funnel": "select * from s_funnel",
    "item_stats": "select * from i_stats",
    "item_funnel": "select * from i_funnel",
    "daily_item_rank": "select * from i_daily",
    "item_rank_by_day": "select * from i_by_day",
    "session_recency": "select * replace (round(log_recency_score, 6) as log_recency_score, "
    "round(type_weighted_log_recency_score, 6) as type_weighted_log_recency_score) from recency",
    "session_recency_baskets": "select * replace (round(log_recency_score, 6) as log_recency_score, "
    "round(type_weighted_log_recency_score, 6) as type_weighted_log_recency_score) from recency_baskets",
    "session_item_stats": "select * from si_stats",
    "candidate_features": "select * from feats",
    "features_with_scores": "select * from feats left join dist_merged using (session, aid)",
    "item_knn_lsh": "select * from lsh",
    "item_knn": "select * from knn",
    "item_knn_cells": "select * from knn",
    "session_item_distance": "select * from dist_typed",
    "pair_score": """
select m.aid, m.aid_next, count(*) as n, round(list_dot_product(any_value(a.vector), any_value(b.vector)), 6) as score
from moves m join vec a on m.aid = a.aid join vec b on m.aid_next = b.aid group by 1, 2""",
    "pair_negatives": "select session, pos, aid, aid_next, aid_wrong from wrong",
    "pair_accuracy": """
select (count(*) * 2)::bigint as scored, round((sum((r > 0.5)::int) + sum((w < 0.5)::int))::double / (count(*) * 2), 6)
  as accuracy from (
  select 1 / (1 + exp(-list_dot_product(a.vector, b.vector))) as r,
    1 / (1 + exp(-list_dot_product(a.vector, c.vector))) as w
  from wrong m join vec a on m.aid = a.aid join vec b on m.aid_next = b.aid join vec c on m.aid_wrong = c.aid)""",
    "embedding_wide": "select vec_id as aid, "
    + ", ".join(f"embedding[{i + 1}] as embedding{i}" for i in range(64))
    + " from embeddings",
    "zip_explode": "select * from last_near",
    "labeled_candidates": "select * from labeled",
    "target_sessions": "select * from tgt_carts",
    "positive_list": "select * from pos_orders",
    "negative_sample": "select * from neg_carts",
    "global_negative_sample": f"""
select session, aid, gt from labeled where gt = 1 union all
select session, aid, gt from (
  select *, row_number() over (order by {_hash('session', 'aid')}, session, aid) as rn from labeled where gt = 0)
where rn <= 5 * (select count(*) from labeled where gt = 1)""",
    "class_balance": "select gt, count(*) as size from labeled group by 1",
    "session_sample": f"""
select session, aid, ts, type from train where session in (
  select session from (select distinct session from train)
  order by {_hash('session', seed=42)}, session limit 200)""",
    "folds": f"""
select session, session_length,
  ((row_number() over (order by session_length desc, {_hash('session')}, session) - 1) % 5)::bigint as fold
from (select session, count(*) as session_length from test group by 1)""",
    "row_shuffle": f"""
select *, row_number() over (order by {_hash('session', 'pos', seed=3)}, session, pos) - 1 as place from moves""",
    "next_item_pairs": "select * from moves",
    "next_item_pairs_baskets": """
select aid, aid_next, count(*) as moves from (
  select aid, lead(aid) over (partition by session order by ts, aid, type) as aid_next from baskets)
where aid_next is not null group by 1, 2""",
    "pair_holdout": f"""
select session, ts, pos, aid, aid_next,
  (row_number() over (order by {_hash('session', 'pos')}, session, pos) <= 1000)::bigint as valid from moves""",
    "ratio_split": """
select session, aid, ts, type, (back < case when floor(len * 0.1) > 0 then len // 10
    when len > 1 then 1 else 0 end)::bigint as part from (
  select *, row_number() over (partition by session order by ts desc, aid desc, type desc) - 1 as back,
    count(*) over (partition by session) as len from train)""",
    "kcore_filter": """
select session, aid, ts, type from test
where session in (select session from test group by 1 having count(*) >= 5)
  and aid in (select aid from test group by 1 having count(*) >= 5)""",
    "padded_sequences": """
select session, string_agg(idx::varchar, ' ' order by back desc) || repeat(' 0', (20 - count(*))::int) as aid_list,
  count(*) as item_length
from seq_tail join (select aid, row_number() over (order by aid) as idx from (select distinct aid from train))
using (aid) group by 1""",
    "interaction_matrix": "select session, aid, count(*) as n from ev group by 1, 2",
    "item_index": "select aid, row_number() over (order by aid) - 1 as idx from (select distinct aid from baskets)",
    "item_cardinality": "select greatest(max(aid), max(aid_next)) + 1 as n_items from moves",
    "recall_at_k": "select * from recall_rows",
    "recall_total": "select * from recall_sum",
    "metric_rows": "select 'recall' as metric, type, k, recall as value from recall_rows union all "
    "select 'total recall' as metric, 'all' as type, k, total as value from recall_sum",
    "session_recall": "select * from by_session",
    "recall_pred_driven": """
select type, sum(hits)::bigint as hits, sum(gt_count)::bigint as gt_count, round(sum(hits)::double / sum(gt_count), 6) as recall
from by_session where (session, type) in (select distinct session, type from typed) group by 1""",
    "ndcg_at_20": """
select type, round(avg(coalesce(dcg, 0) / ideal), 6) as ndcg, count(*) as sessions from (
  select g.session, g.type, h.dcg,
    list_sum(list_transform(range(1, least(g.n, 20) + 1), lambda i: 1 / log2(i + 1))) as ideal
  from gt g left join (select session, type, sum(1 / log2(rank + 1)) as dcg from hits where rank <= 20 group by 1, 2) h
    using (session, type)) group by 1""",
    "fold_ensemble": "select * from mean_scores",
    "submission": """
select session::varchar || '_' || type as session_type, string_agg(aid::varchar, ' ' order by score desc, aid) as labels
from (select *, row_number() over (partition by session, type order by score desc, aid) as rn from mean_scores)
where rn <= 20 group by session, type""",
}
CTE["ranked_means"] = """
select m.type, (t.aid is not null)::int as gt, rank() over (partition by m.type order by m.score)
    + (count(*) over (partition by m.type, m.score) - 1) / 2.0::double as place
from mean_scores m left join truth t on t.session = m.session and t.aid = m.aid and t.type = m.type
"""
FINAL["auc"] = """
select type, round((sum(place * gt) - sum(gt) * (sum(gt) + 1) / 2.0::double) / (sum(gt) * (count(*) - sum(gt))), 6) as auc
from ranked_means group by 1"""
for _t in TYPES:
    CTE[f"kept_{_t}"] = f"select session, aid, 1 as gt from pos_{_t} union all select session, aid, 0 as gt from neg_{_t}"
    CTE[f"dealt_{_t}"] = f"""
select session, ((row_number() over (order by n desc, {_hash('session')}, session) - 1) % 5)::bigint as fold
from (select session, count(*) as n from kept_{_t} group by 1)
"""
    CTE[f"labels_{_t}"] = f"""
select k.session, k.aid, '{_t}' as type, d.fold, (t.aid is not null)::bigint as gt from kept_{_t} k
join dealt_{_t} d on d.session = k.session
left join truth t on t.session = k.session and t.aid = k.aid and t.type = '{_t}'
"""
CTE["labels_all"] = " union all ".join(f"select * from labels_{_t}" for _t in TYPES)
CTE["in_order"] = " union all ".join(
    f"""select l.*, row_number() over (partition by l.session order by f.covisit_{_t}_candidate_num, l.aid) as rank
from labels_{_t} l join feats f on f.session = l.session and f.aid = l.aid"""
    for _t in TYPES
)
CTE["order_ndcg"] = """
select type, round(avg(dcg / ideal), 6) as ndcg from (
  select type, session, coalesce(sum(1 / log2(rank + 1)) filter (where gt = 1 and rank <= 20), 0) as dcg,
    list_sum(list_transform(range(1, least(sum(gt), 20)::bigint + 1), lambda i: 1 / log2(i + 1))) as ideal
  from in_order group by 1, 2 having sum(gt) > 0) group by 1
"""
FINAL["rank_lambda"] = """
select l.session, l.aid, l.type, l.fold, l.gt, true as finite, o.ndcg as order_ndcg, true as above
from labels_all l join order_ndcg o on o.type = l.type"""
for _name in ("rank_gbt_reg", "rank_gbt_clf", "rank_pairwise", "rank_ndcg"):
    FINAL[_name] = "select session, aid, type, fold, gt, true as finite, true as learned from labels_all"
FINAL["boosting_curve"] = """
select type, fold, true as best_is_highest, true as one_best, true as stops
from (select unnest(['clicks', 'carts', 'orders']) as type) cross join (select unnest(range(5)) as fold)"""
FINAL["ranker_rows"] = """
select * from feats join (select session, aid, gt, fold from labels_carts) using (session, aid)
left join dist_merged using (session, aid)"""
for _name, _says in (("cv_recall", "ok"), ("cv_recall_lambda", "above")):
    FINAL[_name] = f"""
select type, fold, sum(gt_count)::bigint as gt_count, round(sum(hits)::double / sum(gt_count), 6) as order_recall, true as {_says}
from gt join (select session, type, fold, count(*) filter (where gt = 1 and rank <= 20) as hits from in_order group by all) using (session, type)
group by grouping sets ((type, fold), (type))"""
FINAL["submission_of_models"] = """
select session::varchar || '_' || type as session_type, least(20, n) as n, true as "distinct"
from (select session, count(*) as n from merged group by 1) cross join (select unnest(['clicks', 'carts', 'orders']) as type)"""
FINAL["submission_of_lambda"] = FINAL["submission_of_models"]
CTE["placed"] = "select session, aid, row_number() over (partition by session order by ts, aid, type) as pos from baskets"
FINAL["window_pair_counts"] = """
select x.aid, y.aid as aid_near, count(*) as n from placed x join placed y on x.session = y.session and y.pos > x.pos and y.pos <= x.pos + 25
group by 1, 2"""
CTE["train_placed"] = "select session, aid, row_number() over (partition by session order by ts, aid, type) as pos from train"
CTE["near_pairs"] = """
select a as aid, b as aid_near, count(*) as n from (
  select x.aid as a, y.aid as b from train_placed x join train_placed y on x.session = y.session and y.pos > x.pos and y.pos <= x.pos + 25
  union all select y.aid, x.aid from train_placed x join train_placed y on x.session = y.session and y.pos > x.pos and y.pos <= x.pos + 25)
group by 1, 2"""
CTE["near_columns"] = "select aid_near, pow(sum(n)::double, 0.75::double) as n_b from near_pairs group by 1"
CTE["pmi_cells"] = """
select p.aid, p.aid_near, round(ln(p.n * (select sum(n_b) from near_columns) / (r.n_a * c.n_b)), 6) as pmi from near_pairs p
join (select aid, sum(n) as n_a from near_pairs group by 1) r on r.aid = p.aid join near_columns c on c.aid_near = p.aid_near"""
FINAL["skip_gram_cells"] = "select * from pmi_cells where pmi > 0"
FINAL["skip_gram_factors"] = """
select count(*) as cells, count(distinct aid) as items, round(sum(pmi * pmi), 3) as norm, true as fits from pmi_cells where pmi > 0"""
FINAL["warp_factors"] = "select count(*) as pairs, true as learned from (select distinct session, aid from train)"
FINAL["next_item_factors"] = "select count(*) as pairs, true as learned from (select distinct aid, aid_next from moves)"
FINAL["w2v_candidates"] = "select distinct session, true as ok from test"
FINAL["mf_candidates"] = "select distinct session, true as ok from test"
FINAL["als_embeddings"] = "select distinct aid, true as finite from train"
FINAL["features_with_session_emb"] = "select session, aid, true as finite from si_stats"
CTE["core0"] = "select * from baskets"
for _i in range(1, 9):  # more passes than any of the tables needs
    _p = f"core{_i - 1}"
    CTE[f"core{_i}"] = f"""
select * from {_p} where session in (select session from {_p} group by 1 having count(*) >= 20)
  and aid in (select aid from {_p} group by 1 having count(*) >= 20)"""
FINAL["kcore_fixpoint"] = "select session, aid, ts, type from core8"
CTE["dist_typed"] = _distances("typed")
CTE["dist_merged"] = _distances("merged")
for _t in TYPES:
    FINAL[f"train_set_{_t}"] = f"""
select * from feats where (session, aid) in
  (select session, aid from pos_{_t} union all select session, aid from neg_{_t})"""


def _names(columns: str) -> list[str]:
    parts, depth, start = [], 0, 0
    for i, ch in enumerate(columns):
        depth += (ch == "(") - (ch == ")")
        if ch == "," and depth == 0:
            parts.append(columns[start:i].strip())
            start = i + 1
    parts.append(columns[start:].strip())
    return [p.split(" as ")[-1].strip() for p in parts]


def _root_splits() -> str:
    """First splits of the list-wise models: gradients at equal scores, quantile bins, the gain of every bin as a cut."""
    names = [*_names(_feature_columns()), "score_mean", "score_std", "score_max", "score_min", "score_length"]
    x = "[" + ", ".join(f"{n}::double" for n in names) + "]"
    rows = " union all ".join(
        f"""select l.*, {x} as x from labels_{t} l join feats f on f.session = l.session and f.aid = l.aid
  left join dist_merged d on d.session = l.session and d.aid = l.aid"""
        for t in TYPES
    )
    unit = 1 << 20

    def part(g: str, h: str) -> str:
        return f"(({g}) / {unit}::double) * (({g}) / {unit}::double) / (({h}) / {unit}::double + 1.0::double)"

    CTE["split_rows"] = rows
    CTE["split_values"] = """
select type, session, aid, fold, unnest(range(len(x))) as feature, unnest(x) as value from split_rows
"""
    CTE["split_edges"] = f"""
select type, feature, list_sort(list_distinct(list_transform(range(1, 64), lambda i: v[(i * len(v)) // 64 + 1]))) as edges from (
  select v.type, v.feature, list_sort(list(v.value)) as v from split_values v join (
    select type, session, aid, row_number() over (partition by type order by {_hash('session', 'aid', seed=29)}, session, aid) as place
    from split_rows) s on s.type = v.type and s.session = v.session and s.aid = v.aid
  where s.place <= 20000 and v.value is not null group by 1, 2)
"""
    CTE["split_places"] = """
select type, session, aid, gt, row_number() over (partition by type, session order by aid) - 1 as place,
  sum(gt) over (partition by type, session) as positives from split_rows
"""
    CTE["split_pairs"] = """
select p.type, p.session, p.aid as good, q.aid as bad, abs(1 / log2(p.place + 2) - 1 / log2(q.place + 2))
    / list_sum(list_transform(range(1, least(p.positives, 20)::bigint + 1), lambda i: 1 / log2(i + 1))) as change
from split_places p join split_places q on p.type = q.type and p.session = q.session and p.gt = 1 and q.gt = 0
where least(p.place, q.place) < 20
"""
    CTE["split_gradients"] = f"""
select type, session, aid, round_even(sum(g) * {unit}, 0)::bigint as g, round_even(sum(h) * {unit}, 0)::bigint as h from (
  select type, session, good as aid, -0.5::double * change as g, 0.25::double * change as h from split_pairs union all
  select type, session, bad as aid, 0.5::double * change as g, 0.25::double * change as h from split_pairs) group by 1, 2, 3
"""
    CTE["split_cells"] = """
select v.type, v.fold, v.feature, case when v.value is null then 0 else 1 + len(list_filter(e.edges, lambda x: x <= v.value)) end as bin,
  coalesce(sum(d.g), 0) as g, coalesce(sum(d.h), 0) as h, count(*) as n
from split_values v left join split_edges e on e.type = v.type and e.feature = v.feature
left join split_gradients d on d.type = v.type and d.session = v.session and d.aid = v.aid group by all
"""
    CTE["split_sums"] = """
select type, model, feature, bin, sum(g) over upto as g, sum(h) over upto as h, sum(n) over upto as n,
  sum(g) over whole_ as gg, sum(h) over whole_ as hh, sum(n) over whole_ as nn
from (select c.type, m.model, c.feature, c.bin, sum(c.g) as g, sum(c.h) as h, sum(c.n) as n
  from split_cells c join (select unnest(range(5)) as model) m on c.fold <> m.model group by all)
window upto as (partition by type, model, feature order by bin), whole_ as (partition by type, model, feature)
"""
    listed = "[" + ", ".join(f"'{n}'" for n in names) + "]"
    return f"""
select type, model as fold, {listed}[feature + 1] as feature, bin::bigint as bin, round(gain, 6) as gain, n::bigint as rows_left, (nn - n)::bigint as rows_right
from (select *, row_number() over (partition by type, model order by gain desc, feature, bin) as place
  from (select *, {part('g', 'h')} + {part('gg - g', 'hh - h')} - {part('gg', 'hh')} as gain from split_sums
    where n >= 20 and nn - n >= 20) where gain > 1e-6) where place = 1"""


FINAL["lambda_root_split"] = _root_splits()


def _sql(final: str) -> str:
    """The statement with the CTEs it needs, in dependency order."""
    needed: list[str] = []

    def visit(text: str) -> None:
        for name in CTE:
            if re.search(rf"\b(from|join|,)\s+{name}\b", text) and name not in needed:
                visit(CTE[name])
                if name not in needed:
                    needed.append(name)

    visit(final)
    if not needed:
        return final
    return "with " + ",\n".join(f"{n} as ({CTE[n].strip()}\n)" for n in needed) + "\n" + final.strip()


def _compact_sql() -> str:
    kinds = []
    for name in _names(_feature_columns()):
        if name in ("min_day_num", "max_day_num"):
            kind = "smallint"
        elif "_cnt_day" in name or "_rank_day" in name:
            kind = "integer"
        elif name.endswith(("_cnt", "_unique_aid", "_rank")) and not name.startswith("avg_"):
            kind = "integer"
        else:
            kind = "double"
        kinds.append(f"{name}::{kind} as {name}")
    return "select session, aid, " + ", ".join(kinds) + " from feats"


FINAL["features_compact"] = _compact_sql()
ORACLES = {key: _sql(text) for key, text in FINAL.items()}
