"""Shared SQL: the canonical views and the protocol as common table expressions (DuckDB)."""

from __future__ import annotations

SEED, K, THRESHOLD = 20260907, 100, 4.0

RATINGS = """ratings AS (
  SELECT o_custkey AS "userId", l_partkey AS "movieId", max(greatest(1.0::DOUBLE, ceil(l_quantity / 5.0)) * 0.5) AS rating, max(epoch(o_orderdate))::BIGINT AS "timestamp"
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL)"""
MOVIES = """movies AS (
  SELECT p_partkey AS "movieId", p_name || ' (' || (1950 + p_size) || ')' AS title, concat_ws('|', p_type, split_part(p_name, ' ', 1), split_part(p_name, ' ', 2)) AS genres FROM part)"""
TAGS = """tags AS (
  SELECT user_id AS "userId", json_extract_string(props, '$.k')::BIGINT AS "movieId", CASE WHEN event_type <> 'error' THEN event_type END AS tag, epoch(ts)::BIGINT AS "timestamp" FROM events)"""
SPLITS = """splits AS (
  SELECT "userId", "movieId", rating, "timestamp",
    CASE WHEN a > n - floor(n * 0.1::DOUBLE) THEN 'test' WHEN a > n - floor(n * 0.1::DOUBLE) - floor(n * 0.1::DOUBLE) THEN 'val' ELSE 'train' END AS split
  FROM (SELECT *, count(*) OVER (PARTITION BY "userId") AS n, row_number() OVER (PARTITION BY "userId" ORDER BY "timestamp", "movieId") AS a FROM ratings)),
train AS (SELECT * FROM splits WHERE split = 'train')"""
GENRES = """mg AS (SELECT DISTINCT "movieId", genre FROM (SELECT "movieId", unnest(string_split(genres, '|')) AS genre FROM movies) WHERE genre NOT IN ('', '(no genres listed)'))"""
LIKED = f"""liked AS (SELECT DISTINCT "userId", "movieId" FROM train WHERE rating >= {THRESHOLD})"""
BASE = ",\n".join([RATINGS, MOVIES, SPLITS])
FULL = ",\n".join([BASE, GENRES, LIKED])


def hexes(text: str, start: int = 1) -> str:
    return f"('0x' || substr({text}, {start}, 8))::BIGINT"


def keyed(purpose: str, *columns: str) -> str:
    return "md5(concat_ws(':', '" + f"{SEED}', '{purpose}', " + ", ".join(f'"{c}"' for c in columns) + "))"


def pick(source: str, order: str, name: str) -> str:
    """One row of each user."""
    return f"""{name} AS (SELECT * EXCLUDE (r) FROM (SELECT *, row_number() OVER (PARTITION BY "userId" ORDER BY {order}) AS r FROM ({source})) WHERE r = 1)"""


CATALOG = f"""catalog AS (SELECT "movieId", row_number() OVER (ORDER BY {keyed("catalog", "movieId")}) - 1 AS idx FROM (SELECT DISTINCT "movieId" FROM movies))"""


def walk(name: str, users: str, catalog: str, blocked: str, k: int, purpose: str) -> str:
    """``name``(userId, target_ts, movieId, n): the walk through the shuffled catalog."""
    h = keyed(purpose, "userId")
    return f"""{name}_size AS (
  SELECT size, (SELECT min(p) FROM range(size, size + 2000) t(p) WHERE p >= 2 AND NOT EXISTS (SELECT 1 FROM range(2, 3000) u(d) WHERE d * d <= p AND p % d = 0)) AS prime FROM (SELECT count(*) AS size FROM {catalog})),
{name}_seen AS (SELECT "userId", count(*) AS c FROM {blocked} GROUP BY 1),
{name}_walk AS (
  SELECT "userId", target_ts, unnest(range(least(coalesce(c, 0) + {k} + prime - size, prime))) AS j, {hexes(h)} % greatest(prime - 1, 1) + 1 AS a, {hexes(h, 9)} % prime AS b, prime
  FROM {users} LEFT JOIN {name}_seen USING ("userId"), {name}_size),
{name} AS (
  SELECT "userId", target_ts, "movieId", n FROM (
    SELECT w."userId", w.target_ts, c."movieId", row_number() OVER (PARTITION BY w."userId" ORDER BY w.j) AS n
    FROM {name}_walk w JOIN {catalog} c ON c.idx = (w.a * w.j + w.b) % w.prime
    WHERE NOT EXISTS (SELECT 1 FROM {blocked} x WHERE x."userId" = w."userId" AND x."movieId" = c."movieId")) WHERE n <= {k})"""


CANDIDATES = (
    f"""{BASE}, {CATALOG},
{pick(f"SELECT * FROM splits WHERE split = 'test' AND rating >= {THRESHOLD}", keyed("pick", "userId", "movieId") + ', "movieId"', "chosen")},
cu AS (SELECT "userId", "timestamp" AS target_ts FROM chosen),
cb AS (SELECT DISTINCT "userId", "movieId" FROM splits SEMI JOIN cu USING ("userId")),
{walk("cw", "cu", "catalog", "cb", K, "candidates")},
candidates AS (
  SELECT row_number() OVER (ORDER BY "userId", label DESC, "movieId") - 1 AS cand_id, "userId", "movieId", label::TINYINT AS label, target_ts FROM (
    SELECT "userId", "movieId", 1 AS label, "timestamp" AS target_ts FROM chosen UNION ALL SELECT "userId", "movieId", 0, target_ts FROM cw))"""
)
RANKED = """scores AS (SELECT c.*, coalesce(p.n, 0)::DOUBLE AS score FROM candidates c LEFT JOIN (SELECT "movieId", count(*) AS n FROM train GROUP BY 1) p USING ("movieId")),
ranked AS (SELECT *, row_number() OVER (PARTITION BY "userId" ORDER BY score DESC, "movieId") AS rank FROM scores),
per_user AS (SELECT "userId", rank, CASE WHEN rank <= 10 THEN 1.0 / log2(rank + 1.0) ELSE 0.0 END AS ndcg, rank <= 10 AS hit FROM ranked WHERE label = 1)"""
COSINE = """item_n AS (SELECT "movieId", count(*) AS c FROM liked GROUP BY 1),
half AS (
  SELECT src, dst, k / sqrt((a.c * b.c)::DOUBLE) AS sim FROM (
    SELECT x."movieId" AS src, y."movieId" AS dst, count(*) AS k FROM liked x JOIN liked y ON x."userId" = y."userId" AND x."movieId" < y."movieId" GROUP BY ALL)
  JOIN item_n a ON a."movieId" = src JOIN item_n b ON b."movieId" = dst),
cosine AS (SELECT src, dst, sim FROM half UNION ALL SELECT dst, src, sim FROM half),
top50 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY sim DESC, dst) AS rank FROM cosine) WHERE rank <= 50)"""


def groups(hard: str) -> str:
    """Training groups: ``hard`` is "", "popular" or "real" (half of the negatives)."""
    n_hard = K // 2 if hard else 0
    made = {
        "": """hard AS (SELECT "userId", target_ts, "movieId" FROM gu, movies WHERE false)""",
        "popular": f"""pool AS (SELECT "movieId", row_number() OVER (ORDER BY {keyed("pool", "movieId")}) - 1 AS idx FROM (SELECT "movieId" FROM train GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 5000)),
{walk("hw", "gu", "pool", "gs", n_hard, "hard")},
hard AS (SELECT "userId", target_ts, "movieId" FROM hw)""",
        "real": f"""hard AS (SELECT "userId", target_ts, "movieId" FROM (
  SELECT "userId", target_ts, "movieId", row_number() OVER (PARTITION BY "userId" ORDER BY {keyed("real", "userId", "movieId")}, "movieId") AS r FROM train JOIN gu USING ("userId") WHERE rating < {THRESHOLD}) WHERE r <= {n_hard})""",
    }[hard]
    return f"""{BASE}, {CATALOG},
{pick(f"SELECT * FROM train WHERE rating >= {THRESHOLD}", keyed("group", "userId", "movieId") + ', "movieId"', "chosen")},
gu AS (SELECT "userId", "timestamp" AS target_ts FROM chosen),
gs AS (SELECT DISTINCT "userId", "movieId" FROM splits SEMI JOIN gu USING ("userId")),
{made},
gb AS (SELECT "userId", "movieId" FROM gs UNION SELECT "userId", "movieId" FROM hard),
{walk("ew", "gu", "catalog", "gb", K, "easy")},
hn AS (SELECT "userId", count(*) AS h FROM hard GROUP BY 1),
groups AS (
  SELECT "userId", "movieId", 1::TINYINT AS label, "timestamp" AS target_ts FROM chosen
  UNION ALL SELECT "userId", "movieId", 0::TINYINT, target_ts FROM hard
  UNION ALL SELECT ew."userId", "movieId", 0::TINYINT, target_ts FROM ew LEFT JOIN hn USING ("userId") WHERE n <= {K} - coalesce(h, 0))"""


PAIRS = """tp AS (SELECT g.*, t.rating AS own FROM groups g LEFT JOIN train t USING ("userId", "movieId"))"""
COUNTS = f"""ms AS (SELECT "movieId", count(*) AS n, sum(rating) AS s, count(*) FILTER (rating >= {THRESHOLD}) AS p FROM train GROUP BY 1),
us AS (SELECT "userId", count(*) AS n, sum(rating) AS s, count(*) FILTER (rating >= {THRESHOLD}) AS p FROM train GROUP BY 1),
prior AS (SELECT quantile_cont(n, 0.9) AS m, sum(s) / sum(n) AS mu FROM ms),
cat AS (SELECT "movieId", coalesce(n, 0) AS n, coalesce(s, 0.0) AS s, coalesce(p, 0) AS p FROM (SELECT DISTINCT "movieId" FROM movies) FULL JOIN ms USING ("movieId"))"""


def pagerank(iterations: int, damping: float = 0.85) -> str:
    """``pr``(movieId, pagerank) by unrolled iterations."""
    steps = [
        """pu AS (SELECT DISTINCT "userId" AS id FROM train), pi AS (SELECT DISTINCT "movieId" AS id FROM train),
pn AS (SELECT (SELECT count(*) FROM pu) + (SELECT count(*) FROM pi) AS n),
du AS (SELECT "userId" AS id, count(*) AS d FROM liked GROUP BY 1), di AS (SELECT "movieId" AS id, count(*) AS d FROM liked GROUP BY 1),
u0 AS (SELECT id, 1.0::DOUBLE / n AS r FROM pu, pn), i0 AS (SELECT id, 1.0::DOUBLE / n AS r FROM pi, pn)"""
    ]
    for k in range(iterations):
        for a, b, x, y in (("u", "i", "userId", "movieId"), ("i", "u", "movieId", "userId")):
            steps.append(
                f"""{a}{k + 1} AS (SELECT v.id, (1.0 - {damping}) / n + {damping} * coalesce(c, 0.0) AS r FROM p{a} v LEFT JOIN (
  SELECT l."{x}" AS id, sum(r / d) AS c FROM liked l JOIN {b}{k} q ON q.id = l."{y}" JOIN d{b} e ON e.id = q.id GROUP BY 1) s USING (id), pn)"""
            )
    steps.append(f"""pr AS (SELECT id AS "movieId", r * (SELECT count(*) / sum(r) FROM i{iterations}) AS pagerank FROM i{iterations})""")
    return ",\n".join(steps)


def communities(iterations: int) -> str:
    """``lp``(movieId, label) by unrolled synchronous label propagation over top50."""
    steps = ["""lw AS (SELECT src, dst, sum(sim) AS w FROM (SELECT src, dst, sim FROM top50 UNION ALL SELECT dst, src, sim FROM top50) WHERE src <> dst GROUP BY ALL),
l0 AS (SELECT DISTINCT src AS "movieId", src AS label FROM lw)"""]
    for k in range(iterations):
        steps.append(
            f"""l{k + 1} AS (SELECT src AS "movieId", label FROM (
  SELECT src, label, row_number() OVER (PARTITION BY src ORDER BY w DESC, label) AS r FROM (
    SELECT src, label, round(sum(w), 9) AS w FROM lw JOIN l{k} ON l{k}."movieId" = dst GROUP BY ALL)) WHERE r = 1)"""
        )
    steps.append(f"lp AS (SELECT * FROM l{iterations})")
    return ",\n".join(steps)
