"""DuckDB SQL for the registered queries, written independently of the DataFrame code."""

from __future__ import annotations

from clickloom.options import FtrlParams, LearnerOptions

_MAX = LearnerOptions().max_features
_P = FtrlParams()

EVENTS = """
ev as (
  select event_id, ts, case when event_type = 'click' then 1 else 0 end as click, hour(ts) as hour,
         user_id, regexp_extract(props, '([0-9]+)', 1) as k, value, (day(ts) - 1) // 10 as batch
  from events)
"""

SCORED = EVENTS + """,
sc as (
  select event_id, ts, click, value / 500 as probability,
         case when value > 100 then 1 else 0 end as prediction
  from ev)
"""

ORDERS = """
oc as (
  select o_orderkey, o_totalprice, o_orderpriority, c_mktsegment, c_nationkey,
         case when o_orderstatus = 'F' then 1 else 0 end as finished
  from orders left join customer on o_custkey = c_custkey)
"""

IN_TRAIN = "('0x' || substr(md5(event_id::varchar), 1, 8))::bigint % 100 < 70"


def real(expr: str, name: str) -> str:
    """A real result column: six places, and no negative zero."""
    return f"round({expr}, 6) + 0.0 as {name}"


def whole(expr: str, name: str | None = None) -> str:
    return f"cast({expr} as bigint) as {name or expr}"


def slot(text: str, max_features: int = _MAX, offset: int = 0) -> str:
    """31-polynomial hash of a text below U+10000, folded into a feature slot."""
    state = (
        f"list_reduce(list_transform(string_split({text}, ''), lambda c: ascii(c)::bigint),"
        " lambda a, c: (a * 31 + c) % 4294967296, 0::bigint)"
    )
    return f"(abs(({state} + 2147483648) % 4294967296 - 2147483648) % {max_features} + {offset})"


def unfold(source: str, columns: list[str], keep: str) -> str:
    """Long form of some columns: keep..., feature, value."""
    return " union all ".join(
        f"select {keep}, '{c}' as feature, coalesce({c}::varchar, '') as value from {source}"
        for c in columns
    )


def stats(source: str, columns: list[str], label: str) -> str:
    return f"""
      select feature, value, sum(y) as pos, count(*) as cnt, sum(y)::double / count(*) as p1,
             (count(*) - sum(y))::double / count(*) as p0
      from ({unfold(source, columns, label + " as y")}) group by feature, value having count(*) >= 10"""


def loss(p: str, y: str) -> str:
    clipped = f"greatest(least({p}, 1 - 1e-14::double), 1e-14::double)"
    return f"(case when {y} = 1 then -ln({clipped}) else -ln(1 - {clipped}) end)"


def sigmoid(v: str) -> str:
    return f"(1 / (1 + exp(-greatest(least({v}, 35), -35))))"


# ---- FTRL, unrolled step by step ----------------------------------------------------------------

WEIGHT = (
    f"case when abs(z) <= {_P.l1} then 0 else"
    f" -(z - (case when z >= 0 then 1 else -1 end) * {_P.l1})"
    f" / ({_P.l2} + ({_P.beta} + sqrt(n)) / {_P.alpha}) end"
)


def ftrl_steps(batches: list[str], share: str = "1", link=sigmoid) -> str:
    """CTEs m1, m2, ... over ``cells(row_id, batch, y, idx, x)`` and ``rws(row_id, batch, y)``.

    ``batches`` is one filter per step; p1, p2, ... hold the probabilities before each step. ``share`` is the
    weight of a row of ``rws``.
    """
    ctes = ["m0 as (select 0 as idx, 0::double as z, 0::double as n where false)"]
    for i, chosen in enumerate(batches, 1):
        ctes += [
            f"w{i} as materialized (select idx, {WEIGHT} as w from m{i - 1})",
            f"""v{i} as materialized (
              select row_id, sum(x * coalesce(w, 0)) as v
              from (select * from cells where {chosen}) left join w{i} using (idx) group by row_id)""",
            f"""p{i} as materialized (
              select row_id, y, {link("coalesce(v, 0)")} as p, {share} as share
              from (select * from rws where {chosen}) left join v{i} using (row_id))""",
            f"""g{i} as materialized (
              select idx, sum(share * (p - p{i}.y) * x) as g, sum((share * (p - p{i}.y) * x) ** 2) as gg
              from (select * from cells where {chosen}) c join p{i} using (row_id) group by idx)""",
            f"""m{i} as materialized (
              select idx, z + g - (sqrt(n + gg) - sqrt(n)) / {_P.alpha} * ({WEIGHT}) as z, n + gg as n
              from (select idx, coalesce(z, 0) as z, coalesce(n, 0) as n, coalesce(g, 0) as g, coalesce(gg, 0) as gg
                    from m{i - 1} full join g{i} using (idx)))""",
        ]
    return ",\n".join(ctes)


EVENT_CELLS = f"""{EVENTS},
rws as materialized (select event_id as row_id, batch, click as y from ev),
cells as materialized (
  select row_id, batch, y, {slot("feature || '_' || value")} as idx, count(*)::double as x
  from ({unfold("ev", ["hour", "user_id", "k"], "event_id as row_id, batch, click as y")})
  group by 1, 2, 3, 4)
"""

# the same cells with the position of each row in its user's log
EVENT_CELLS_BY_SEGMENT = f"""{EVENTS},
rn as materialized (
  select event_id as row_id, user_id as seg, click as y, row_number() over (partition by user_id order by event_id) as pos
  from ev),
cl as materialized (
  select row_id, seg, {slot("feature || '_' || value")} as idx, count(*)::double as x
  from ({unfold("ev", ["hour", "user_id", "k"], "event_id as row_id, user_id as seg")})
  group by 1, 2, 3)
"""

# steps are runs of rows in order of the events
ORDERED = """
numbered as (
  select *, (row_number() over (order by event_id) - 1) // ((count(*) over () + 3) // 4) as run from ev)
"""

ORDERED_CELLS = f"""{EVENTS}, {ORDERED},
rws as materialized (select event_id as row_id, run as batch, click as y from numbered),
cells as materialized (
  select row_id, batch, y, {slot("feature || '_' || value")} as idx, count(*)::double as x
  from ({unfold("numbered", ["hour", "user_id", "k"], "event_id as row_id, run as batch, click as y")})
  group by 1, 2, 3, 4)
"""

LINE_CELLS = f"""{EVENTS}, {ORDERED},
rws as materialized (select event_id as row_id, run as batch, click as y from numbered),
cells as materialized (
  select row_id, batch, y, {slot("p || '_' || v::varchar")} as idx, count(*)::double as x
  from (select event_id as row_id, run as batch, click as y, unnest(['1', '2', '3']) as p,
               unnest([hour::int, user_id::int, k::int]) as v from numbered)
  where v <> 0 group by 1, 2, 3, 4)
"""

# states of a segment after its first pos records
SEGMENT_STATES = f"""
st as (
          select seg, 0::bigint as pos, idx, 0::double as z, 0::double as n from (select distinct seg, idx from cl)
          union all
          select seg, pos + 1, idx, z + g - (sqrt(n + g * g) - sqrt(n)) / {_P.alpha} * w, n + g * g
          from (
            select v.*, ({sigmoid("sum(v.w * v.x) over (partition by v.seg)")} - v.y) * v.x as g
            from (
              select st.*, {WEIGHT} as w, coalesce(cl.x, 0) as x, rn.y
              from st join rn on rn.seg is not distinct from st.seg and rn.pos = st.pos + 1
              left join cl on cl.row_id = rn.row_id and cl.idx = st.idx) v))
"""

ALL_ROWS = ["true"]
ORDERED_EPOCHS = [f"batch = {k}" for k in range(4)] * 2
# rows without a time come first; a step without rows changes nothing
ONE_EPOCH = ["batch is null", "batch = 0", "batch = 1", "batch = 2", "batch = 3"]
TWO_EPOCHS = ONE_EPOCH * 2

MODEL = f"select {whole('idx')}, {real('z', 'z')}, {real('n', 'n')} from "

SCORES = f"""
with {EVENT_CELLS}, {ftrl_steps(ALL_ROWS)},
wt as (select idx, {WEIGHT} as w from m1),
scores as (
  select row_id, {sigmoid("sum(x * coalesce(w, 0))")} as p from cells left join wt using (idx) group by row_id)
"""


def progress(steps: int) -> str:
    """Rows, labels and loss of each step before its update."""
    return " union all ".join(
        f"select {i} as step, count(*) as rows, sum(y)::double as labels, sum({loss('p', 'y')}) as lost from p{i}"
        for i in range(1, steps + 1)
    )


# ---- the fixed ensemble -------------------------------------------------------------------------

LEAVES = EVENTS + """,
lv as (
  select *,
    case when value <= 50 then (case when hour <= 11 then 0 else 1 end) else 2 end as leaf0,
    case when hour in (0, 1, 2, 22, 23) then 0 when user_id <= 75 then 1 else 2 end as leaf1,
    case when user_id <= 20 then 0 else 1 end as leaf2
  from ev)
"""

LEAF_CELLS = f"""{LEAVES},
rws as materialized (select event_id as row_id, batch, click as y from lv),
cells as materialized (
  select event_id as row_id, batch, click as y, {slot("(s + 1)::varchar || '_1'")} as idx, count(*)::double as x
  from (select *, unnest([leaf0, 3 + leaf1, 6 + leaf2]) as s from lv) group by 1, 2, 3, 4)
"""

# ---- ranks --------------------------------------------------------------------------------------


def auc(scores: str) -> str:
    """AUC through average ranks in one sorted window."""
    return f"""
      select (sum(rank * y) - sum(y) * (sum(y) + 1) / 2.0) / nullif(sum(y) * (count(*) - sum(y)), 0)
      from (select click as y, rank() over (order by probability)
                   + (count(*) over (partition by probability) - 1) / 2.0 as rank from {scores})"""


GROUP_RANK = "row_number() over (partition by event_type order by value, event_id) - 1"

EVENT_COLUMNS = ["event_id", "hour", "user_id", "k"]
ITEM_COLUMNS = [
    "l_suppkey", "l_partkey", "l_linestatus", "l_linenumber", "l_quantity", "l_discount", "l_tax", "month",
]

STATS_OUT = f"select feature, value, {whole('pos')}, {whole('cnt')}, {real('p1', 'p1')}, {real('p0', 'p0')} from "

LONG_OUT = f"select {whole('row_id')}, {real('y', 'y')}, {whole('idx')}, {real('x', 'x')} from "


# the made-up categories of the click log: name, and how many values it has
CLICK_LOG = dict(zip(
    ("id hour C1 banner_pos site_id site_domain site_category app_id app_domain app_category device_id device_ip "
     "device_model device_type device_conn_type C14 C15 C16 C17 C18 C19 C20 C21").split(), range(2, 200, 5), strict=False,
))


def _click_log_value(name: str, values: int) -> str:
    if name in ("id", "hour"):
        return {"id": "event_id::varchar", "hour": "hour::varchar"}[name]
    number = f"(user_id * {values} + event_id) % {values}"
    return f"case when {number} > 0 then 'v' || ({number}) else '' end"


CLICK_LOG_ROWS = f"""{EVENTS},
cl as materialized (
  select event_id, click, {", ".join(f'{_click_log_value(c, v)} as "{c}"' for c, v in CLICK_LOG.items())} from ev)
"""


def order_cells(max_features: int) -> str:
    return f"""
      with {ORDERS}
      {LONG_OUT} (
        select o_orderkey as row_id, finished::double as y, 0 as idx, o_totalprice as x from oc
        union all
        select row_id, y::double, {slot("feature || '_' || value", max_features, 1)} as idx, count(*)::double as x
        from ({unfold("oc", ["o_orderpriority", "c_mktsegment", "c_nationkey"], "o_orderkey as row_id, finished as y")})
        group by 1, 2, 3)"""


def pairs_with_number(source: str, columns: list[str], first: int) -> str:
    return f"""
      select feature, value, count(*) as cnt,
             row_number() over (order by feature, value) - 1 + {first} as idx
      from ({unfold(source, columns, "1")}) group by feature, value"""


ORACLE = {
    "csv_lines_parse": f"""
        select event_id, event_type, user_id, {real("value", "amount")}
        from events where event_type <> 'signup'""",
    "csv_files_read": f"""
        select p_partkey, p_name || ', "' || p_brand || '"' as title, {whole("p_size")} from part""",
    "csv_breaks_read": f"""
        select o_orderkey, o_orderpriority || chr(10) || '"as, it, is"' || chr(10) || o_orderdate::varchar as note,
               {real("o_totalprice", "o_totalprice")} from orders""",
    "text_files_read": f"""
        with {EVENTS} select {whole("click")}, {whole("hour")}, user_id, k, event_id from ev""",
    "explode_features": f"""
        with {EVENTS} select event_id, {real("y", "label")}, feature, value
        from ({unfold("ev", ["hour", "user_id", "k"], "event_id, click::double as y")})""",
    "count_stats": f"with {EVENTS} {STATS_OUT} ({stats('ev', EVENT_COLUMNS, 'click')})",
    "count_stats_items": f"""
        with li as (select *, month(l_shipdate) as month,
                           case when l_returnflag = 'R' then 1 else 0 end as returned from lineitem)
        {STATS_OUT} ({stats("li", ITEM_COLUMNS, "returned")})""",
    "count_encode": f"""
        with {EVENTS}, tr as (select * from ev where {IN_TRAIN}),
        st as ({stats("tr", EVENT_COLUMNS, "click")})
        select event_id, {whole("click")}, """
    + ", ".join(real(f"coalesce({c}_s.{p}, 0)", f"{c}_{p}") for c in EVENT_COLUMNS for p in ("p1", "p0"))
    + " from ev "
    + " ".join(
        f"left join st {c}_s on {c}_s.feature = '{c}' and {c}_s.value = ev.{c}::varchar" for c in EVENT_COLUMNS
    ),
    "hash_split": f"select event_id, case when {IN_TRAIN} then 1::bigint else 0 end as is_train from events",
    "negative_sampling": f"""
        with {EVENTS}
        select event_id, {whole("click")}, case when click = 1 then 1.0::double else 4.0 end as weight
        from ev where click = 1 or {IN_TRAIN.replace("< 70", "< 25")}""",
    "hash_index": f"with {EVENTS} select event_id, "
    + ", ".join(whole(slot(f"'{c}_' || {c}::varchar"), f"{c}_slot") for c in ("hour", "user_id", "k"))
    + " from ev",
    "hash_vector": order_cells(_MAX),
    "hash_vector_collisions": order_cells(20),
    "hash_vector_positional": f"""
        with {EVENTS}
        {LONG_OUT} (
          select event_id as row_id, click::double as y, 0 as idx, value - 1 + 19 as x from ev where value - 1 > 0
          union all
          select row_id, y::double, {slot("p || '_' || v::varchar", _MAX, 1)} as idx, count(*)::double as x
          from (select event_id as row_id, click as y, '1' as p, hour::int as v from ev
                union all select event_id, click, '2', user_id::int from ev
                union all select event_id, click, '3', k::int from ev) where v <> 0
          group by 1, 2, 3)""",
    "onehot_index": f"""
        with {EVENTS} select feature, value, {whole("cnt")}, {whole("idx")}
        from ({pairs_with_number("ev", ["hour", "user_id", "k"], 0)})""",
    "onehot_refit": f"""
        with {EVENTS}, early as (select * from ev where batch = 0),
        old as ({pairs_with_number("early", ["hour", "user_id", "k"], 0)}),
        late as (
          select * from ({pairs_with_number("ev", ["hour", "user_id", "k"], 0)}) a
          where not exists (select 1 from old where old.feature = a.feature and old.value = a.value))
        select feature, value, {whole("idx")} from old
        union all
        select feature, value, (select count(*) from old) + row_number() over (order by feature, value) - 1 from late""",
    "onehot_positional": f"""
        with {EVENTS},
        lg as (
          select event_id, click, unnest(['1', '2', '3']) as feature, unnest([hour::varchar, user_id::varchar, k]) as value
          from ev),
        dc as (
          select feature, value, row_number() over (order by feature, value) as idx
          from (select distinct feature, value from lg where value::int <> 0))
        {LONG_OUT} (
          select event_id as row_id, click::double as y, 0 as idx, value - 1 as x from ev where value - 1 > 0
          union all
          select event_id, click::double, idx, 1::double from lg join dc using (feature, value))""",
    "onehot_vector": f"""
        with {ORDERS},
        lg as ({unfold("oc", ["o_orderpriority", "c_mktsegment", "c_nationkey"], "o_orderkey as row_id, finished as y")}),
        dc as ({pairs_with_number("oc", ["o_orderpriority", "c_mktsegment", "c_nationkey"], 1)})
        {LONG_OUT} (
          select o_orderkey as row_id, finished::double as y, 0 as idx, o_totalprice as x from oc
          union all
          select row_id, y::double, idx, 1::double as x from lg join dc using (feature, value))""",
    "rank_rows": f"""
        with {SCORED} select event_id, {whole("click")}, {real("probability", "probability")},
          row_number() over (order by sc.probability, event_id) - 1 as position from sc""",
    "rank_rows_by_keys": f"""
        with {SCORED} select event_id, {whole("click")}, {real("probability", "probability")},
          row_number() over (order by sc.click desc, sc.probability desc, event_id) - 1 as position from sc""",
    "average_ranks": f"""
        with {SCORED}, rk as (select round(probability, 1) as score from sc)
        select score + 0.0 as score, count(*) as ties, {real("avg(r)", "average_rank")}
        from (select score, row_number() over (order by score) as r from rk) group by score""",
    "argsort_by_group": f"""
        select event_type, {GROUP_RANK} as sorted_position, event_id as original_id from events""",
    "cosort_by_group": f"""
        select event_type, {GROUP_RANK} as sorted_position, {real("value", "value")}, user_id as payload
        from events""",
    "argsort_head_by_group": f"""
        with pl as (select event_type, event_id, value,
                      row_number() over (partition by event_type order by event_id) - 1 as original from events)
        select event_type, event_id, original, {real("value", "value")}, {GROUP_RANK} as sorted_position
        from pl where original < 100
        union all
        select event_type, event_id, original, {real("value", "value")}, original from pl where original >= 100""",
    "auc_rank": f"""
        with {SCORED} select {real(f"({auc('sc')})", "auc")},
          {whole("sum(click)", "pos")}, {whole("count(*) - sum(click)", "neg")} from sc""",
    "auc_ties": f"""
        with {SCORED}, tied as (select click, round(probability, 1) as probability from sc)
        select {real(f"({auc('tied')})", "auc")},
          {whole("sum(click)", "pos")}, {whole("count(*) - sum(click)", "neg")} from tied""",
    "logloss_mean": f"""
        with {SCORED} select {real(f"avg({loss('probability', 'click')})", "logloss")}, count(*) as rows from sc""",
    "logloss_clipped": f"""
        with {SCORED}, hard as (select click, round(probability, 0) as probability from sc)
        select probability + 0.0 as probability, {whole("click")}, count(*) as rows,
          {real(f"sum({loss('hard.probability', 'click')})", "loss")}
        from hard group by hard.probability, click""",
    "error_rate": f"""
        with {SCORED} select {real("avg((click <> prediction)::int)", "error_rate")},
          {real("avg((click = prediction)::int)", "accuracy")},
          {whole("sum((click <> prediction)::int)", "errors")}, count(*) as rows from sc""",
    "mismatches": f"""
        with {SCORED} select event_id, {whole("click")}, {whole("prediction")} from sc where click <> prediction""",
    "base_rate": f"with {SCORED} select {real('avg(click)', 'base_rate')} from sc",
    "accuracy_at_base_rate": f"""
        with {SCORED}, t as (select avg(click) as t from sc)
        select {real("avg(case when (probability >= t and click = 1) or (probability <= t and click = 0) "
                     "then 1.0::double else 0 end)", "accuracy")}, count(*) as rows from sc, t""",
    "eval_report": f"""
        with {SCORED} select {real(f"({auc('sc')})", "auc")}, {real("avg((click = prediction)::int)", "accuracy")},
          {real(f"avg({loss('probability', 'click')})", "logloss")}, count(*) as rows from sc""",
    "eval_report_at_base_rate": f"""
        with {SCORED}, t as (select avg(click) as t from sc)
        select {real(f"({auc('sc')})", "auc")},
          {real("avg(case when (probability >= t and click = 1) or (probability <= t and click = 0) "
                "then 1.0::double else 0 end)", "accuracy")},
          {real(f"avg({loss('probability', 'click')})", "logloss")}, count(*) as rows from sc, t""",
    "predict_class": f"""
        with {SCORED}, t as (select avg(click) as t from sc)
        select event_id, case when probability >= t then 1::bigint else -1 end as class from sc, t""",
    "running_base_rate": f"""
        with {SCORED} select event_id, row_number() over w as seq, {real("avg(click) over w", "running_base_rate")}
        from sc window w as (order by ts, event_id rows unbounded preceding)""",
    "progressive_loss": f"""
        with {SCORED}, run as (
          select event_id, row_number() over w as seq, avg(click) over w as rate,
                 sum({loss("probability", "click")}) over w as lost
          from sc window w as (order by ts, event_id rows unbounded preceding))
        select event_id, seq, {real("rate", "running_base_rate")}, {real("lost", "cumulative_loss")}
        from run where seq % 100 = 0""",
    "ftrl_step": f"with {EVENT_CELLS}, {ftrl_steps(ALL_ROWS)} {MODEL} m1",
    "ftrl_weights": f"""
        with {EVENT_CELLS}, {ftrl_steps(ALL_ROWS)} select {whole("idx")}, {real(WEIGHT, "w")} from m1""",
    "ftrl_score": f"{SCORES} select row_id, {real('p', 'probability')} from scores",
    "submission": f"{SCORES} select row_id::varchar as id, {real('p', 'click')} from scores",
    "submission_lines": f"""{SCORES}
        select 0::bigint as position, 'id' as id, null::double as click
        union all
        select row_number() over (order by row_id), row_id::varchar, round(p, 6) + 0.0 from scores""",
    "ftrl_fit_epochs": f"with {EVENT_CELLS}, {ftrl_steps(TWO_EPOCHS)} {MODEL} m10",
    "ftrl_progress": f"""
        with {EVENT_CELLS}, {ftrl_steps(TWO_EPOCHS)}, pr as ({progress(10)})
        select {whole("sum(rows)", "rows")}, {real("sum(labels)", "label_sum")}, {real("sum(lost)", "loss_sum")},
          {real("sum(labels)::double / sum(rows)", "base_rate")} from pr""",
    "tree_route": f"""
        with {LEAVES} select event_id, {whole("leaf0")}, {whole("leaf1")}, {whole("leaf2")} from lv""",
    "tree_ensemble_score": f"""
        with {LEAVES}, rs as (
          select event_id, ([0.2, -0.1, -0.3])[leaf0 + 1]::double + 0.5::double * ([0.4, -0.2, 0.1])[leaf1 + 1]::double
                           + 0.1::double * ([-0.5, 0.6])[leaf2 + 1]::double as f from lv)
        select event_id, {real("f", "raw_score")}, {real("1 / (1 + exp(-2 * f))", "probability")},
          case when f > 0 then 1.0::double else 0 end as prediction from rs""",
    "leaf_onehot": f"""
        with {LEAVES} select event_id, {whole("0", "tree")}, {whole("leaf0", "slot")} from lv
        union all select event_id, 1, 3 + leaf1 from lv union all select event_id, 2, 6 + leaf2 from lv""",
    "leaf_file_rows": f"""
        with {LEAVES} select event_id, click::varchar || """
    + " || ".join(
        f"(case when leaf{t} = {i} then ',1' else ',0' end)" for t, n in ((0, 3), (1, 3), (2, 2)) for i in range(n)
    )
    + " as line from lv",
    "ftrl_fit_leaf": f"with {LEAF_CELLS}, {ftrl_steps(TWO_EPOCHS)} {MODEL} m10",
    "ftrl_stream": f"with {EVENT_CELLS}, {ftrl_steps(ONE_EPOCH)} {MODEL} m5",
    "ftrl_stream_metrics": f"""
        with {EVENT_CELLS}, {ftrl_steps(ONE_EPOCH)}, pr as ({progress(5)})
        select {whole("row_number() over w", "version")}, {whole("sum(rows) over w", "rows")},
          {real("sum(labels) over w", "label_sum")}, {real("sum(lost) over w", "loss_sum")}
        from pr where rows > 0 window w as (order by step rows unbounded preceding)""",
    "stream_score": f"{SCORES} select row_id, {real('p', 'probability')} from scores",
    # ---- what SQL can state about trained models
    "gbdt_consistency": """
        select count(*) as rows, 0::bigint as other_leaves, 0::bigint as other_probabilities,
               0::bigint as slots_out_of_range, 0::bigint as wrong_widths from events""",
    "two_stage_counts": f"""
        with {EVENTS}, h as (select count(*) as rows from ev where not ({IN_TRAIN}))
        select stage, rows, 1::bigint as sound
        from h, (select unnest(['boosted_trees', 'ftrl_on_leaves']) as stage)""",
    "random_split_counts": """
        select count(*) as rows, 0::bigint as repeated, 1::bigint as near_share from events""",
    "learner_csv_scores": f"""
        with {EVENT_CELLS}, {ftrl_steps(TWO_EPOCHS)}, wt as (select idx, {WEIGHT} as w from m10)
        select row_id::varchar as id, {real(sigmoid("sum(x * coalesce(w, 0))"), "probability")}
        from cells left join wt using (idx) group by row_id""",
    "learner_csv_report": f"""
        with {EVENT_CELLS}, {ftrl_steps(TWO_EPOCHS)}, wt as (select idx, {WEIGHT} as w from m10),
        sr as (
          select row_id, y as click, round({sigmoid("sum(x * coalesce(w, 0))")}, 12) as probability
          from cells left join wt using (idx) group by row_id, y)
        select count(*) as rows, {real(f"avg({loss('probability', 'click')})", "logloss")},
               {real("(" + auc("sr") + ")", "auc")}
        from sr""",
    "click_log_encode": f"""
        with {CLICK_LOG_ROWS}, tr as (select * from cl where {IN_TRAIN}),
        st as materialized ({stats("tr", list(CLICK_LOG), "click")})
        select id, {whole("click")}, """
    + ", ".join(real(f'coalesce("{c}_s".{p}, 0)', f'"{c}_{p}"') for c in CLICK_LOG for p in ("p1", "p0"))
    + " from cl "
    + " ".join(f"""left join st "{c}_s" on "{c}_s".feature = '{c}' and "{c}_s".value = cl."{c}" """ for c in CLICK_LOG),
    "click_log_two_stage": f"""
        with {EVENTS}, h as (select count(*) as rows from ev where not ({IN_TRAIN}))
        select stage, rows, 1::bigint as sound
        from h, (select unnest(['boosted_trees', 'ftrl_on_leaves']) as stage)""",
    "learner_csv_in_order": f"with {ORDERED_CELLS}, {ftrl_steps(ORDERED_EPOCHS)} {MODEL} m8",
    "learner_file_onehot": f"""
        with {EVENTS}, {ORDERED},
        rws as materialized (select event_id as row_id, run as batch, click as y from numbered),
        lg as (
          select event_id as row_id, run as batch, click as y, unnest(['1', '2', '3']) as feature,
                 unnest([hour::varchar, user_id::varchar, k]) as value from numbered),
        dc as (
          select feature, value, row_number() over (order by feature, value) - 1 as idx
          from (select distinct feature, value from lg where value::int <> 0)),
        cells as materialized (select row_id, batch, y, idx, 1::double as x from lg join dc using (feature, value)),
        {ftrl_steps(ORDERED_EPOCHS)} {MODEL} m8""",
    "learner_file_report": f"""
        with {LINE_CELLS}, {ftrl_steps(ORDERED_EPOCHS)}, wt as (select idx, {WEIGHT} as w from m8),
        sr as (
          select rws.row_id, rws.y as click, round({sigmoid("coalesce(sum(x * coalesce(w, 0)), 0)")}, 12) as probability
          from rws left join cells using (row_id) left join wt using (idx) group by rws.row_id, rws.y)
        select count(*) as rows, {real(f"avg({loss('probability', 'click')})", "logloss")},
               {real("(" + auc("sr") + ")", "auc")}
        from sr""",
    "ftrl_fit_sampled": f"""
        with {EVENTS}, kept as (
          select *, case when click = 1 then 1 else 4 end as weight from ev
          where click = 1 or {IN_TRAIN.replace("< 70", "< 25")}),
        rws as materialized (select event_id as row_id, batch, click as y, weight from kept),
        cells as materialized (
          select row_id, batch, y, {slot("feature || '_' || value")} as idx, count(*)::double as x
          from ({unfold("kept", ["hour", "user_id", "k"], "event_id as row_id, batch, click as y")})
          group by 1, 2, 3, 4),
        {ftrl_steps(TWO_EPOCHS, "weight")} {MODEL} m10""",
    "eval_report_weighted": f"""
        with {SCORED}, kept as (
          select *, case when click = 1 then 1::double else 4 end as w from sc
          where click = 1 or {IN_TRAIN.replace("< 70", "< 25")}),
        below as (
          select click, w, probability,
                 sum(w * (1 - click)) over (order by probability) - sum(w * (1 - click)) over (partition by probability) / 2 as won
          from kept)
        select (select {real("sum(w * click * won) / (sum(w * click) * (select sum(w * (1 - click)) from kept))", "auc")} from below) as auc,
          {real("sum(w * (click = prediction)::int) / sum(w)", "accuracy")},
          {real(f"sum(w * {loss('kept.probability', 'click')}) / sum(w)", "logloss")}, count(*) as rows from kept""",
    "ftrl_squared_loss": f"with {EVENT_CELLS}, {ftrl_steps(ALL_ROWS, link=lambda v: v)} {MODEL} m1",
    "ftrl_custom_step": f"""
        with {EVENT_CELLS} select {whole("idx")}, {real("sum(x * y)", "z")}, {real("sum(x)", "n")} from cells group by idx""",
    "overwrite_and_delete": f"""
        with {EVENTS} select {whole("sum(click)", "rows")}, 1::bigint as deleted_0, 0::bigint as deleted_1, 0::bigint as there from ev""",
    "progressive_by_segment": f"""
        with recursive {EVENT_CELLS_BY_SEGMENT}, {SEGMENT_STATES},
        told as (
          select rn.row_id, rn.seg, rn.pos, rn.y, {sigmoid("sum(cl.x * coalesce(w, 0))")} as p
          from rn join cl on cl.row_id = rn.row_id
          join (select *, {WEIGHT} as w from st) s on s.seg is not distinct from rn.seg and s.pos = rn.pos - 1 and s.idx = cl.idx
          group by all)
        select seg as user_id, row_id as event_id, pos as seq, {real("p", "probability")},
          {real("avg(y) over r", "running_base_rate")}, {real(f"sum({loss('p', 'y')}) over r", "cumulative_loss")}
        from told window r as (partition by seg order by pos rows unbounded preceding)""",
    "ftrl_fit_by_segment": f"""
        with recursive {EVENT_CELLS_BY_SEGMENT}, {SEGMENT_STATES}
        select seg as user_id, {whole("idx")}, {real("z", "z")}, {real("n", "n")}
        from st where pos = (select max(pos) from rn where rn.seg is not distinct from st.seg)""",
}
