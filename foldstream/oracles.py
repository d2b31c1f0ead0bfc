"""SQL with the same results as the queries, for DuckDB over the same tables."""

from __future__ import annotations

M = 1000003

INTERACTIONS = """inter AS (
  SELECT o_custkey AS user_id, l_partkey AS item_id, 1.0::DOUBLE AS rating, epoch(o_orderdate)::BIGINT AS ts, lineitem.*
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""
REQUESTS = INTERACTIONS + """, req AS (
  SELECT row_number() OVER (ORDER BY ts, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) - 1 AS eval_id,
         user_id, item_id, rating, ts FROM inter)"""


def messages(whole: bool = False) -> str:
    value = "floor(value)::DOUBLE" if whole else "value"
    return f"""msg AS (
  SELECT CASE WHEN event_type IN ('purchase', 'click', 'signup') THEN 'Push' ELSE 'Pull' END AS kind,
         event_id AS src, user_id AS dest, event_id AS seq,
         {value} AS w0, (event_id % 7)::DOUBLE AS w1, (event_id % 3)::DOUBLE AS w2
  FROM events)"""


def comp(key: str, pos: str, lo: float, hi: float, seed: int) -> str:
    """One component of an initial vector."""
    x = f"(((({key})*7919 + ({pos})*104729 + {seed * 1299709 + 12345}) % {M}) + {M}) % {M}"
    y = f"((({x}) * ({x})) % {M})"
    z = f"(((({y} + ({key}) + ({pos})*31) * ({y} + 48271)) % {M}) + {M}) % {M}"
    return f"({lo!r}::DOUBLE + (({z})::DOUBLE / {M}.0::DOUBLE) * {hi - lo!r}::DOUBLE)"


def vec(key: str, dim: int, lo: float, hi: float, seed: int) -> str:
    return "[" + ", ".join(comp(key, str(i), lo, hi, seed) for i in range(dim)) + "]"


def unpack(source: str, keys: str, dim: int = 3, digits: int = 6, value: str = "vec[p]") -> str:
    return (f"SELECT {keys}, (p - 1)::INTEGER AS pos, round({value}, {digits}) + 0.0 AS val "
            f"FROM {source}, (SELECT unnest(range(1, {dim + 1})) AS p)")


def init3(key: str) -> str:
    return vec(key, 3, -1.0, 1.0, 1)


EMB = "(SELECT vec_id, embedding::DOUBLE[] AS q, list_transform(embedding::DOUBLE[], lambda x: x * pow(2, vec_id % 8)) AS v FROM embeddings)"
CUST = f"u AS (SELECT c_custkey AS user_id, {vec('c_custkey', 10, -1.0, 1.0, 1)} AS uvec FROM customer)"
PART = f"i AS (SELECT p_partkey AS item_id, {vec('p_partkey', 10, -1.0, 1.0, 2)} AS ivec FROM part)"
SCORED = "s AS (SELECT user_id, item_id, round(list_dot_product(uvec, ivec), 9) + 0.0 AS score FROM u, i)"


def best(source: str, k: int, by: str = "user_id") -> str:
    return (f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY score DESC, item_id)::INTEGER AS rank "
            f"FROM {source}) WHERE rank <= {k}")


TOP = f"WITH {INTERACTIONS}, {CUST}, {PART}, {SCORED}, top AS ({best('s', 10)}), want AS (SELECT DISTINCT user_id, item_id FROM inter)"
GAIN = """gain AS (SELECT top.user_id, sum(1.0 / log2(rank + 1)) AS dcg FROM top JOIN want USING (user_id, item_id) GROUP BY 1),
  ideal AS (SELECT user_id, (SELECT sum(1.0 / log2(p + 1)) FROM range(1, 11) r(p) WHERE p <= n) AS idcg
            FROM (SELECT user_id, count(*) AS n FROM want GROUP BY 1))"""


def fixed_report(ascending: bool = False) -> str:
    place = "(11 - rank)" if ascending else "rank"
    return f"""WITH {INTERACTIONS},
  u AS (SELECT user_id, {vec('user_id', 10, -1.0, 1.0, 1)} AS uvec FROM (SELECT DISTINCT user_id FROM inter)),
  i AS (SELECT item_id, {vec('item_id', 10, -1.0, 1.0, 2)} AS ivec FROM (SELECT DISTINCT item_id FROM inter)),
  {SCORED}, top AS ({best('s', 10)})
SELECT ts // 86400 AS time_slot, round(avg(CASE WHEN rank IS NULL THEN 0.0 ELSE 1.0 / (log2({place}) + 1) END), 6) + 0.0 AS ndcg, count(*) AS n
FROM inter LEFT JOIN top USING (user_id, item_id) GROUP BY 1"""


ASOF = f"""run AS (
  SELECT *, first_value(kind) OVER w AS first,
         [sum(coalesce(CASE WHEN kind = 'Push' THEN w0 END, 0)) OVER w,
          sum(coalesce(CASE WHEN kind = 'Push' THEN w1 END, 0)) OVER w,
          sum(coalesce(CASE WHEN kind = 'Push' THEN w2 END, 0)) OVER w] AS pushed
  FROM msg WINDOW w AS (PARTITION BY dest ORDER BY seq ROWS UNBOUNDED PRECEDING)),
 val AS (SELECT *, CASE WHEN first = 'Pull' THEN {init3('dest')} ELSE [0.0, 0.0, 0.0] END AS start FROM run)"""
SUPP = f"held AS (SELECT s_suppkey AS id, {vec('s_suppkey', 3, -1.0, 1.0, 2)} AS hvec FROM supplier)"


def totals(cast: str = "{}") -> str:
    parts = ", ".join(f"coalesce(sum(CASE WHEN kind = 'Push' THEN {cast.format(f'w{i}')} END), 0) AS s{i}" for i in range(3))
    return f"tot AS (SELECT dest AS id, arg_min(kind, seq) AS first, count(*) FILTER (kind = 'Push') AS pushes, {parts} FROM msg GROUP BY 1)"


def merged(cast: str = "{}") -> str:
    return f"""WITH {messages()}, {SUPP}, {totals(cast)},
 m AS (SELECT coalesce(held.id, tot.id) AS id, coalesce(s0, 0) AS s0, coalesce(s1, 0) AS s1, coalesce(s2, 0) AS s2,
         coalesce(hvec, CASE WHEN first = 'Pull' THEN {init3('tot.id')} END) AS start, pushes
       FROM held FULL JOIN tot ON held.id = tot.id),
 r AS (SELECT id, [coalesce(start[1], 0) + s0, coalesce(start[2], 0) + s1, coalesce(start[3], 0) + s2] AS vec
       FROM m WHERE start IS NOT NULL OR pushes > 0)
{unpack('r', 'id')}"""


PUSHED = f"pushed AS (SELECT dest AS id, [sum(w0), sum(w1), sum(w2)] AS vec FROM msg WHERE kind = 'Push' GROUP BY 1)"

SYNC = f"""WITH {messages()}, {ASOF},
 walk AS (SELECT *, sum(CASE WHEN kind = 'Pull' THEN 1 ELSE -1 END) OVER w AS level, count(*) FILTER (kind = 'Pull') OVER w AS pull_no
          FROM val WINDOW w AS (PARTITION BY dest ORDER BY seq ROWS UNBOUNDED PRECEDING)),
 low AS (SELECT *, least(0, min(level) OVER (PARTITION BY dest ORDER BY seq ROWS UNBOUNDED PRECEDING)) AS floor FROM walk),
 st AS (SELECT *, level - floor AS outstanding, (pull_no - level) + floor AS completed FROM low),
 -- a push completes a pull when something was outstanding just before it
 push AS (SELECT * FROM (SELECT *, lag(outstanding, 1, 0) OVER (PARTITION BY dest ORDER BY seq) AS before FROM st)
          WHERE kind = 'Push' AND before > 0),
 ans AS (SELECT p.dest AS src, p.src AS dest, CASE WHEN p.outstanding = 1 THEN p.seq ELSE c.seq END AS answered_at,
           CASE WHEN p.outstanding = 1 THEN p.pushed ELSE c.pushed END AS pushed, p.start AS start
         FROM st p LEFT JOIN push c ON c.dest = p.dest AND c.completed = p.pull_no - 1 WHERE p.kind = 'Pull')
SELECT src, dest, answered_at, round(start[1] + pushed[1], 6) + 0.0 AS v0, round(start[2] + pushed[2], 6) + 0.0 AS v1,
       round(start[3] + pushed[3], 6) + 0.0 AS v2 FROM ans"""

LOCAL = f"WITH {INTERACTIONS}, {CUST}, {PART}, {SCORED}, sh AS (SELECT *, (item_id % 4)::INTEGER AS shard FROM s), loc AS ({best('sh', 5, 'user_id, shard')})"
MERGED_EVALS = f"""{LOCAL}, ask AS (SELECT user_id, min(item_id) AS target_id, max(ts) AS ts FROM inter GROUP BY 1),
  l2 AS (SELECT user_id, item_id, score FROM loc), top AS ({best('l2', 10)})
SELECT user_id AS eval_id, target_id, ts, rank, item_id, score FROM ask JOIN top USING (user_id)"""

NEG = "((((eval_id * 31 + j * 17) % n) * 48271) % n)"


def pairs(source: str, items: str, rate: int, tag: str) -> str:
    """CTEs idx{tag} and pair{tag}: item positions and training pairs."""
    return f"""idx{tag} AS (SELECT id, row_number() OVER (ORDER BY id) - 1 AS idx, count(*) OVER () AS n FROM {items}),
 pair{tag} AS (
  SELECT eval_id, user_id, j, idx.id AS item_id, CASE WHEN j = 0 THEN d.rating ELSE 0.0 END AS rating
  FROM (SELECT r.*, own.idx AS own, own.n, j, CASE WHEN j = 0 THEN own.idx ELSE {NEG} END AS k
        FROM {source} r JOIN idx{tag} own ON own.id = r.item_id, (SELECT unnest(range(0, {rate + 1})) AS j)) d
  JOIN idx{tag} idx ON idx.idx = d.k WHERE j = 0 OR d.k <> own)"""


def step(source: str, users: str, items: str, tag: str, user_floats: bool = False) -> str:
    """CTEs u{tag} and i{tag}: users and items (id, vec) after training on `source`. With `user_floats` what a request
    adds to its user is a float."""
    sums_u = ", ".join(f"sum(e * iv[{c}])" for c in range(1, 11))
    sums_i = ", ".join(f"sum(e * uv[{c}])" for c in range(1, 11))
    of_users = f"SELECT user_id AS id, [{sums_u}] AS d FROM term{tag} GROUP BY 1"
    if user_floats:
        each = ", ".join(f"sum(e * iv[{c}])::FLOAT::DOUBLE AS d{c}" for c in range(1, 11))
        sums = ", ".join(f"sum(d{c})" for c in range(1, 11))
        of_users = f"SELECT user_id AS id, [{sums}] AS d FROM (SELECT user_id, eval_id, {each} FROM term{tag} GROUP BY 1, 2) GROUP BY 1"
    add = lambda a, b: "[" + ", ".join(f"coalesce({a}[{c}], 0) + coalesce({b}[{c}], 0)" for c in range(1, 11)) + "]"
    return f"""{pairs(source, items, 9, tag)},
 term{tag} AS (SELECT eval_id, user_id, item_id, u.vec AS uv, i.vec AS iv, 0.4 * (rating - list_dot_product(u.vec, i.vec)) AS e
   FROM pair{tag} p JOIN {users} u ON u.id = p.user_id JOIN {items} i ON i.id = p.item_id),
 du{tag} AS ({of_users}),
 di{tag} AS (SELECT item_id AS id, [{sums_i}] AS d FROM term{tag} GROUP BY 1),
 u{tag} AS MATERIALIZED (SELECT id, {add('a.vec', 'b.d')} AS vec FROM {users} a LEFT JOIN du{tag} b USING (id)),
 i{tag} AS MATERIALIZED (SELECT id, {add('a.vec', 'b.d')} AS vec FROM {items} a LEFT JOIN di{tag} b USING (id))"""


SMALL_USERS = f"u0 AS MATERIALIZED (SELECT id, {vec('id', 10, -0.001, 0.001, 1)} AS vec FROM (SELECT DISTINCT user_id AS id FROM req))"
SMALL_ITEMS = f"i0 AS MATERIALIZED (SELECT id, {vec('id', 10, -0.001, 0.001, 2)} AS vec FROM (SELECT DISTINCT item_id AS id FROM req))"


YEAR = 365 * 86_400


def prequential(seconds: int, k: int = 100, requests: str = REQUESTS, growing: bool = False) -> str:
    """CTE res (eval_id, ndcg, ts): each slot evaluated with the vectors of the slots before it.

    Slots run from 1995-01-01 to 2001-08-01. With `growing` an item is known, and has a place, from the first slot that asks for it.
    """
    first, last = 788_918_400 // seconds, 996_624_000 // seconds
    ctes = [requests.replace("req AS (", "req AS MATERIALIZED ("), SMALL_USERS]
    if growing:
        ctes += [SMALL_ITEMS.replace("i0 AS", "all0 AS"),
                 f"born AS MATERIALIZED (SELECT item_id AS id, min(ts // {seconds}) AS slot FROM req GROUP BY 1)",
                 "i0 AS MATERIALIZED (SELECT id, vec, NULL::BIGINT AS idx FROM all0 WHERE false)"]
    else:
        ctes.append(SMALL_ITEMS)
    for s in range(last - first + 1):
        ctes.append(f"r{s} AS MATERIALIZED (SELECT * FROM req WHERE ts // {seconds} = {first + s})")
        scored = (f"(SELECT u.id AS user_id, i.id AS item_id, round(list_dot_product(u.vec, i.vec), 9) + 0.0 AS score "
                  f"FROM (SELECT * FROM u{s} WHERE id IN (SELECT user_id FROM r{s})) u, i{s} i)")
        ctes.append(f"top{s} AS ({best(scored, k)})")
        ctes.append(f"res{s} AS MATERIALIZED (SELECT eval_id, CASE WHEN rank IS NULL THEN 0.0 ELSE 1.0 / (log2(rank) + 1) END AS ndcg, ts "
                    f"FROM r{s} LEFT JOIN top{s} USING (user_id, item_id))")
        if s == last - first:
            break
        if growing:
            ctes.append(f"""k{s} AS MATERIALIZED (SELECT id, vec, idx FROM i{s} UNION ALL
  SELECT id, vec, (SELECT count(*) FROM i{s}) + row_number() OVER (ORDER BY id) - 1 FROM all0 JOIN born USING (id) WHERE slot = {first + s})""")
            made = step(f"r{s}", f"u{s}", f"k{s}", str(s + 1))
            made = made.replace("row_number() OVER (ORDER BY id) - 1 AS idx, count(*) OVER () AS n", "idx, count(*) OVER () AS n", 1)
            made = made.replace(f"i{s + 1} AS MATERIALIZED (SELECT id, ", f"i{s + 1} AS MATERIALIZED (SELECT id, a.idx, ")
            ctes.append(made)
        else:
            ctes.append(step(f"r{s}", f"u{s}", f"i{s}", str(s + 1)))
    ctes.append("res AS (" + " UNION ALL ".join(f"SELECT * FROM res{s}" for s in range(last - first + 1)) + ")")
    return "WITH " + ",\n ".join(ctes)


REPORT = "SELECT ts // 86400 AS time_slot, round(avg(ndcg), 6) + 0.0 AS ndcg, count(*) AS n FROM res GROUP BY 1"
# the job numbers requests by time, user and item, as the file has no more
JOB_REQUESTS = INTERACTIONS + """, req AS (
  SELECT row_number() OVER (ORDER BY ts, user_id, item_id) - 1 AS eval_id, user_id, item_id, rating, ts FROM inter)"""


ORACLES: dict[str, str] = {
    "interactions_scan": f"WITH {INTERACTIONS} SELECT user_id, item_id, rating, ts FROM inter",
    "interactions_file": f"WITH {INTERACTIONS} SELECT user_id, item_id, rating, ts FROM inter",
    "interactions_offset": f"WITH {INTERACTIONS} SELECT l_orderkey AS eval_id, user_id, item_id, rating, ts - 1000000007 AS ts FROM inter",
    "dense_ids": f"WITH {REQUESTS} SELECT eval_id, user_id, item_id, rating, ts FROM req",
    "model_scan": unpack(EMB, "vec_id AS id", 64, 9, "q[p]"),
    "model_decode": unpack(EMB, "vec_id AS id", 64, 9, "q[p]"),
    "model_encode": f"WITH {messages(True)} SELECT src || ':' || w0 || ',' || w1 || ',' || w2 AS value FROM msg WHERE kind = 'Push'",
    "message_decode": f"WITH {messages(True)} SELECT kind, src, dest, CASE WHEN kind = 'Push' THEN w0 END AS v0, "
                      "CASE WHEN kind = 'Push' THEN w1 END AS v1, CASE WHEN kind = 'Push' THEN w2 END AS v2 FROM msg",
    "answer_decode": f"WITH {messages()} SELECT dest AS src, src AS dest, (src % 7)::DOUBLE AS v0, dest::DOUBLE AS v1 FROM msg WHERE kind = 'Pull'",
    "message_encode": f"""WITH {messages(True)}
SELECT CASE WHEN kind = 'Pull' THEN 'Pull:' || src || ':' || dest ELSE 'Push:' || src || ':' || dest || ':' || w0 || ',' || w1 || ',' || w2 END AS value FROM msg
UNION ALL SELECT dest || ':' || src || ':' || src::DOUBLE || ',1.0' FROM msg WHERE kind = 'Pull'""",
    "result_lines": fixed_report(),
    "split_tagged": """SELECT count(*) AS n, round(sum(value), 4) AS total, 'left' AS side FROM events WHERE event_type = 'view'
UNION ALL SELECT count(*), round(sum(value), 4), 'right' FROM events WHERE event_type IS DISTINCT FROM 'view'""",
    "message_counts": f"WITH {messages()} SELECT dest, count(*) FILTER (kind = 'Pull') AS pulls, count(*) FILTER (kind = 'Push') AS pushes FROM msg GROUP BY 1",
    "union_outputs": """SELECT 'server' AS side, event_id AS id, value AS val FROM events
UNION ALL SELECT 'worker', o_orderkey, o_totalprice FROM orders""",
    "warm_start": f"""WITH {messages()}, {PUSHED},
 usr AS (SELECT coalesce(c_custkey, id) AS id, {vec('c_custkey', 3, -1.0, 1.0, 3)} AS a, vec AS b FROM customer FULL JOIN pushed ON id = c_custkey),
 u2 AS (SELECT id, [coalesce(a[1], 0) + coalesce(b[1], 0), coalesce(a[2], 0) + coalesce(b[2], 0), coalesce(a[3], 0) + coalesce(b[3], 0)] AS vec FROM usr),
 it AS (SELECT p_partkey AS id, {vec('p_partkey', 3, -1.0, 1.0, 4)} AS vec FROM part)
SELECT *, 'user' AS side FROM ({unpack('u2', 'id')})
UNION ALL SELECT *, 'item' FROM ({unpack('it', 'id')})
UNION ALL SELECT o_custkey, 0, count(*)::DOUBLE, 'request' FROM orders GROUP BY 1""",
    "pull_or_init": f"""WITH {messages()}, {PUSHED},
 a AS (SELECT o_custkey AS src, o_orderkey AS dest, coalesce(vec, {init3('o_custkey')}) AS vec FROM orders LEFT JOIN pushed ON id = o_custkey)
{unpack('a', 'src, dest')}""",
    "append_initialised": f"""WITH {messages()}, {PUSHED},
 a AS (SELECT id, vec FROM pushed UNION ALL
       SELECT o_custkey, {init3('o_custkey')} FROM (SELECT DISTINCT o_custkey FROM orders) WHERE o_custkey NOT IN (SELECT id FROM pushed))
{unpack('a', 'id')}""",
    "pull_asof": f"WITH {messages()}, {ASOF} {unpack('val', 'dest AS src, src AS dest', value='start[p] + pushed[p]')} WHERE kind = 'Pull'",
    "pull_asof_held": f"WITH {messages()}, {ASOF}, {SUPP}, v2 AS (SELECT val.*, coalesce(hvec, start) AS st FROM val LEFT JOIN held ON held.id = val.dest) "
                      f"{unpack('v2', 'dest AS src, src AS dest', value='st[p] + pushed[p]')} WHERE kind = 'Pull'",
    "vector_sum": f"WITH {messages()}, {PUSHED} {unpack('pushed', 'id')}",
    "vector_sum_any": f"""WITH e AS (SELECT label::BIGINT AS id, e2.v FROM embeddings JOIN {EMB} e2 USING (vec_id))
SELECT id, (p - 1)::INTEGER AS pos, round(sum(v[p]), 6) + 0.0 AS val FROM e, (SELECT unnest(range(1, 65)) AS p) GROUP BY ALL""",
    "push_merge": merged(),
    "push_float32": merged("CAST(CAST({} AS FLOAT) AS DOUBLE)"),
    "item_set": f"""WITH {messages()}, {SUPP},
 last AS (SELECT dest AS id, arg_max([w0, w1, w2], seq) AS vec FROM msg WHERE kind = 'Push' GROUP BY 1),
 r AS (SELECT coalesce(held.id, last.id) AS id, coalesce(vec, hvec) AS vec FROM held FULL JOIN last ON held.id = last.id)
{unpack('r', 'id')}""",
    "param_fold_custom": f"""WITH {messages()}, mx AS (SELECT dest AS id, max(w0) AS m0, max(w1) AS m1, max(w2) AS m2 FROM msg WHERE kind = 'Push' GROUP BY 1),
 b AS (SELECT *, {init3('id')} AS s FROM mx), r AS (SELECT id, [greatest(m0, s[1]), greatest(m1, s[2]), greatest(m2, s[3])] AS vec FROM b)
{unpack('r', 'id')}""",
    "sync_param": SYNC,
    "init_vectors": unpack(f"(SELECT c_custkey AS id, {vec('c_custkey', 10, -0.001, 0.001, 1)} AS vec FROM customer)", "id", 10, 12),
    "init_missing": f"""WITH f AS (SELECT user_id AS id, (event_id % 5)::INTEGER AS pos, max(value) AS val FROM events GROUP BY 1, 2),
 g AS (SELECT c_custkey AS id, p::INTEGER AS pos FROM customer, (SELECT unnest(range(0, 8)) AS p))
SELECT id, pos, round(coalesce(val, {comp('id', 'pos', -1.0, 1.0, 1)}), 9) + 0.0 AS val FROM g FULL JOIN f USING (id, pos)""",
    "vector_from_fields": """WITH f AS (SELECT user_id AS id, (event_id % 5)::INTEGER AS pos, max(value) AS val FROM events GROUP BY 1, 2),
 l AS (SELECT id, count(*)::INTEGER AS size, list(val ORDER BY pos) AS vec FROM f GROUP BY 1)
SELECT id, size, vec[1] AS v0, vec[2] AS v1, vec[3] AS v2, vec[4] AS v3, vec[5] AS v4 FROM l""",
    "vector_to_fields": f"SELECT vec_id AS item_id, (p - 1)::INTEGER AS pos, v[p] AS val FROM {EMB}, (SELECT unnest(range(1, 65)) AS p)",
    "dot_product": f"SELECT vec_id AS item_id, round(list_dot_product(q, v), 6) AS dot FROM {EMB}",
    "length_sq": f"SELECT vec_id AS item_id, round(list_dot_product(v, v), 6) AS length_sq FROM {EMB}",
    "vector_add": unpack(EMB, "vec_id AS item_id", 64, 6, "q[p] + v[p]"),
    "score_pairs": f"""WITH {CUST}, {PART}, s AS (SELECT user_id, list_dot_product(uvec, ivec) AS x FROM u, i)
SELECT user_id, count(*) AS n, round(avg(x), 6) + 0.0 AS mean, round(min(x), 6) + 0.0 AS lo, round(max(x), 6) + 0.0 AS hi FROM s GROUP BY 1""",
    "local_topk": f"{LOCAL} SELECT user_id, item_id, score, shard, rank FROM loc",
    "global_topk": f"{TOP} SELECT user_id, item_id, score, rank FROM top",
    "pruned_topk": f"""WITH u AS (SELECT vec_id AS user_id, q AS uvec FROM {EMB}), i AS (SELECT vec_id AS item_id, v AS ivec FROM {EMB}), {SCORED}
SELECT user_id, item_id, score, rank FROM ({best('s', 10)})""",
    "shard_topk": f"{LOCAL} SELECT user_id, item_id, score, shard, rank FROM loc WHERE shard = user_id % 4",
    "ndcg_single": f"""{TOP} SELECT user_id, item_id, round(CASE WHEN rank IS NULL THEN 0.0 ELSE 1.0 / (log2(rank) + 1) END, 9) AS ndcg
FROM want LEFT JOIN top USING (user_id, item_id) WHERE user_id IN (SELECT user_id FROM top)""",
    "dcg": f"{TOP}, {GAIN} SELECT user_id, round(coalesce(dcg, 0), 9) AS dcg FROM (SELECT DISTINCT user_id FROM top) LEFT JOIN gain USING (user_id)",
    "idcg": f"WITH {INTERACTIONS}, want AS (SELECT DISTINCT user_id, item_id FROM inter), {GAIN.split('ideal AS')[1].join(['ideal AS', ''])} "
            "SELECT user_id, round(idcg, 9) AS idcg FROM ideal",
    "ndcg_list": f"{TOP}, {GAIN} SELECT user_id, round(coalesce(dcg, 0) / idcg, 9) AS ndcg FROM (SELECT DISTINCT user_id FROM top) JOIN ideal USING (user_id) LEFT JOIN gain USING (user_id)",
    "correlate_requests": """SELECT o_orderkey AS eval_id, o_custkey AS src, coalesce(user_id, -1) AS item_id, coalesce(epoch(ts)::BIGINT, -1) AS ts
FROM orders LEFT JOIN (SELECT event_id, user_id, date_trunc('second', ts) AS ts FROM events) e ON event_id = o_orderkey""",
    "cogroup_inputs": """WITH a AS (SELECT l_orderkey AS eval_id, epoch(min(l_shipdate))::BIGINT * 2 + 1 AS answered FROM lineitem GROUP BY 1),
 r AS (SELECT o_orderkey AS eval_id, epoch(o_orderdate)::BIGINT * 2 AS asked FROM orders)
SELECT eval_id, answered, CASE WHEN asked <= answered THEN asked ELSE -1 END AS asked FROM a JOIN r USING (eval_id)""",
    "merge_evaluations": MERGED_EVALS,
    "merge_distinct": MERGED_EVALS,
    "time_slots": f"WITH {INTERACTIONS} SELECT trunc((ts - 900000000) / 86400.0)::BIGINT AS time_slot, count(*) AS n FROM inter GROUP BY 1",
    "ndcg_by_slot": fixed_report(),
    "ndcg_by_slot_ascending": fixed_report(ascending=True),
    "count_window": """WITH r AS (SELECT *, (row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1) // 8 AS win FROM events)
SELECT user_id, win AS "window", min(event_id) AS first_id, max(event_id) AS last_id, round(sum(value), 4) AS total
FROM r GROUP BY 1, 2 HAVING count(*) = 8""",
    "session_by_key": """WITH e AS (SELECT user_id, epoch_us(ts) AS t, value FROM events),
 b AS (SELECT *, CASE WHEN t - lag(t) OVER (PARTITION BY user_id ORDER BY t) <= 21600000000 THEN 0 ELSE 1 END AS opens FROM e),
 g AS (SELECT *, sum(opens) OVER (PARTITION BY user_id ORDER BY t ROWS UNBOUNDED PRECEDING) AS s FROM b)
SELECT user_id, min(t) AS start_us, max(t) AS end_us, count(*) AS n, round(sum(value), 4) + 0.0 AS total FROM g GROUP BY user_id, s""",
    "latency_stats": """WITH l AS (SELECT o_orderpriority, epoch(l_shipdate)::BIGINT - epoch(o_orderdate)::BIGINT AS x FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
 r AS (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY x) AS rn, count(*) OVER (PARTITION BY o_orderpriority) AS c FROM l)
SELECT o_orderpriority, count(*) AS n, round(avg(x), 4) + 0.0 AS mean, min(x) AS lo, max(x) AS hi,
       min(x) FILTER (rn * 100 >= c * 50) AS p50, min(x) FILTER (rn * 100 >= c * 95) AS p95, min(x) FILTER (rn * 100 >= c * 99) AS p99
FROM r GROUP BY 1""",
    "negative_samples": f"""WITH {REQUESTS}, items AS (SELECT DISTINCT item_id AS id FROM req), {pairs('req', 'items', 4, '')}
SELECT eval_id, user_id, j::INTEGER AS j, item_id, rating FROM pair WHERE j > 0""",
    "sgd_step": f"""WITH {REQUESTS.replace('req AS (', 'req AS MATERIALIZED (')}, {SMALL_USERS}, {SMALL_ITEMS}, {step('req', 'u0', 'i0', '1')}
SELECT *, 'user' AS side FROM ({unpack('u1', 'id', 10)}) UNION ALL SELECT *, 'item' FROM ({unpack('i1', 'id', 10)})""",
    "prequential": f"{prequential(YEAR)} SELECT eval_id, round(ndcg, 6) + 0.0 AS ndcg, ts FROM res",
    "prequential_growing": f"{prequential(YEAR, growing=True)} SELECT eval_id, round(ndcg, 6) + 0.0 AS ndcg, ts FROM res",
    "online_train_eval": f"{prequential(YEAR)} {REPORT}",
    "job_report": f"{prequential(YEAR, requests=JOB_REQUESTS, growing=True)} {REPORT}",
    "param_loop": f"""WITH e AS (SELECT event_id, user_id, value, floor(epoch(ts))::BIGINT // 604800 AS wk FROM events),
 w AS (SELECT user_id, wk, sum(value) AS s0, count(*)::DOUBLE AS s1 FROM e GROUP BY 1, 2),
 c AS (SELECT user_id, wk, coalesce(sum(s0) OVER o, 0) AS b0, coalesce(sum(s1) OVER o, 0) AS b1 FROM w
       WINDOW o AS (PARTITION BY user_id ORDER BY wk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
 a AS (SELECT event_id, [b0, b1, 0.0] AS seen, {init3('user_id')} AS start FROM e JOIN c USING (user_id, wk))
{unpack('a', 'event_id', value='start[p] + seen[p]')}""",
}
WIDE_USERS = f"u0 AS MATERIALIZED (SELECT id, {vec('id', 10, -1.0, 1.0, 1)} AS vec FROM (SELECT DISTINCT user_id AS id FROM req))"
WIDE_ITEMS = f"i0 AS MATERIALIZED (SELECT id, {vec('id', 10, -1.0, 1.0, 2)} AS vec FROM (SELECT DISTINCT item_id AS id FROM req))"
ORACLES["sgd_step_float"] = f"""WITH {REQUESTS.replace('req AS (', 'req AS MATERIALIZED (')}, {WIDE_USERS}, {WIDE_ITEMS},
 {step('req', 'u0', 'i0', '1', user_floats=True)}
SELECT *, 'user' AS side FROM ({unpack('u1', 'id', 10, 7)}) UNION ALL SELECT *, 'item' FROM ({unpack('i1', 'id', 10, 7)})"""
ORACLES["pruned_topk_lengths"] = ORACLES["pruned_topk"]
ORACLES["worker_only_loop"] = f"""WITH e AS (SELECT event_id, user_id, value, floor(epoch(ts))::BIGINT // 604800 AS wk FROM events),
 w AS (SELECT user_id, wk, sum(value) AS s0, 4 * count(*)::DOUBLE AS s1 FROM e GROUP BY 1, 2),
 c AS (SELECT user_id, wk, coalesce(sum(s0) OVER o, 0) AS b0, coalesce(sum(s1) OVER o, 0) AS b1 FROM w
       WINDOW o AS (PARTITION BY user_id ORDER BY wk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
 a AS (SELECT event_id, shard, [b0, b1, 0.0] AS seen, {init3('user_id')} AS start
       FROM e JOIN c USING (user_id, wk), (SELECT unnest(range(0, 4))::INTEGER AS shard))
{unpack('a', 'event_id, shard', value='start[p] + seen[p]')}"""
ORACLES["topic_roundtrip"] = ORACLES["message_decode"]
ORACLES["pruned_topk_parts"] = ORACLES["pruned_topk"]
ORACLES["pull_stream"] = ORACLES["pull_asof"]
ORACLES["param_stream"] = f"""WITH {messages()}, {totals()},
 m AS (SELECT *, CASE WHEN first = 'Pull' THEN {init3('id')} ELSE [0.0, 0.0, 0.0] END AS start FROM tot),
 r AS (SELECT id, [start[1] + s0, start[2] + s1, start[3] + s2] AS vec FROM m)
{unpack('r', 'id')}"""
ORACLES["count_window_stream"] = ORACLES["count_window"]
ORACLES["merge_evaluations_stream"] = ORACLES["merge_evaluations"]
ORACLES["session_stream"] = ORACLES["session_by_key"]
ORACLES["dense_ids_stream"] = ORACLES["dense_ids"]
ORACLES["latency_stream"] = ORACLES["latency_stats"].replace(
    "l_orderkey = o_orderkey)", "l_orderkey = o_orderkey\n  WHERE l_shipdate >= o_orderdate AND l_shipdate <= o_orderdate + INTERVAL 200 DAY)")
ORACLES["topic_latest"] = ORACLES["message_decode"] + " WHERE src % 4 <> 0"
ORACLES["model_callbacks"] = f"""WITH {messages()}, {SUPP}, n AS (
  SELECT *, sum(CASE WHEN kind = 'Push' THEN w0 ELSE 0 END) OVER w AS s0, sum(CASE WHEN kind = 'Push' THEN w1 ELSE 0 END) OVER w AS s1,
         sum(CASE WHEN kind = 'Push' THEN w2 ELSE 0 END) OVER w AS s2, count(*) FILTER (kind = 'Push') OVER w AS pushes
  FROM msg WINDOW w AS (PARTITION BY dest ORDER BY seq ROWS UNBOUNDED PRECEDING)),
 a AS (SELECT dest, src, kind, [coalesce(hvec[1], 0) + s0, coalesce(hvec[2], 0) + s1, coalesce(hvec[3], 0) + s2] AS vec
       FROM n LEFT JOIN held ON held.id = dest WHERE kind = 'Pull' AND (hvec IS NOT NULL OR pushes > 0))
{unpack('a', 'dest AS src, src AS dest')}"""
