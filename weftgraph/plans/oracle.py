"""SQL that says, independently of the engine, what its queries over the trade graph return."""

from __future__ import annotations

from itertools import combinations

from weftgraph.plans.pattern import Pattern

GRAPH = """
trade AS MATERIALIZED (
    SELECT o_custkey * 4 AS c, l_suppkey * 4 + 1 AS s, l_partkey * 4 + 2 AS p
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_quantity >= 48 AND l_returnflag = 'R'
), raw AS (
    SELECT c AS a, s AS b FROM trade UNION ALL SELECT s, p FROM trade UNION ALL SELECT c, p FROM trade
    UNION ALL SELECT c_custkey * 4, CAST(c_nationkey AS BIGINT) * 4 + 3 FROM customer
    UNION ALL SELECT s_suppkey * 4 + 1, CAST(s_nationkey AS BIGINT) * 4 + 3 FROM supplier
), edges AS MATERIALIZED (
    SELECT DISTINCT least(a, b) AS src, greatest(a, b) AS dst FROM raw WHERE a <> b
), vertices AS MATERIALIZED (
    SELECT c_custkey * 4 AS id, c_mktsegment AS label FROM customer
    UNION ALL SELECT s_suppkey * 4 + 1, 'SUPPLIER' FROM supplier
    UNION ALL SELECT p_partkey * 4 + 2, p_type FROM part
    UNION ALL SELECT CAST(n_nationkey AS BIGINT) * 4 + 3, 'NATION,R' || n_regionkey FROM nation
), adj AS MATERIALIZED (
    SELECT src, dst FROM edges UNION ALL SELECT dst, src FROM edges
), deg AS MATERIALIZED (
    SELECT id, label, count(src) AS deg FROM vertices LEFT JOIN adj ON id = src GROUP BY id, label
), prof AS MATERIALIZED (
    SELECT id, label, count(*) AS cnt FROM (
        SELECT id, label FROM vertices UNION ALL SELECT src, label FROM adj JOIN vertices ON dst = id
    ) GROUP BY id, label
), tprof AS (
    SELECT id, token, CAST(sum(cnt) AS BIGINT) AS cnt FROM (SELECT id, cnt, unnest(string_split(label, ',')) AS token FROM prof) GROUP BY id, token
)"""


def query(body: str, *more: str, recursive: bool = False, every_item: bool = False) -> str:
    graph = GRAPH.replace(" WHERE l_quantity >= 48 AND l_returnflag = 'R'", "") if every_item else GRAPH
    return f"WITH {'RECURSIVE ' if recursive else ''}{', '.join([graph, *more])}\n{body}"


def _label(column: str, label: str, tokens: bool) -> str:
    if not tokens:
        return f"{column} = '{label}'"
    return " AND ".join(f"len(list_filter(string_split({column}, ','), lambda t: t = '{t}')) >= {label.split(',').count(t)}" for t in sorted(set(label.split(","))))


def candidate(pattern: Pattern, u: int, profile: bool, tokens: bool = False) -> str:
    """SQL for the ids v that vertex u can stand for."""
    where = [_label("label", pattern.labels[u], tokens), f"deg >= {pattern.degree(u)}"]
    if profile:
        table, key, needs = ("tprof", "token", pattern.token_profile(u)) if tokens else ("prof", "label", pattern.profile(u))
        where += [f"id IN (SELECT id FROM {table} WHERE {key} = '{k}' AND cnt >= {n})" for k, n in sorted(needs.items())]
    return f"SELECT id AS v FROM deg WHERE {' AND '.join(where)}"


def candidate_tables(pattern: Pattern, profile: bool, tokens: bool = False, prefix: str = "c") -> list[str]:
    return [f"{prefix}{u} AS MATERIALIZED ({candidate(pattern, u, profile, tokens)})" for u in pattern.vertices]


def candidate_rows(pattern: Pattern, prefix: str = "c") -> str:
    return " UNION ALL ".join(f"SELECT {u} AS u, v FROM {prefix}{u}" for u in pattern.vertices)


def _hall(v: str, near: list[int], table) -> str:
    """Whether the vertices near a pattern vertex can be matched to different neighbours of v; table(w): SQL for the candidates of w."""
    tests = []
    for size in range(1, len(near) + 1):
        for subset in combinations(near, size):
            union = " UNION ".join(f"SELECT v FROM {table(w)}" for w in subset)
            tests.append(f"{v} IN (SELECT src FROM adj WHERE dst IN ({union}) GROUP BY src HAVING count(DISTINCT dst) >= {size})")
    return " AND ".join(tests) or "true"


def refined(prefix: str, u: int) -> str:
    return f"{prefix}{u}"


def refined_tables(pattern: Pattern, edges: list[tuple[int, int]], order: list[int], passes: int, prefix: str = "c") -> tuple[list[str], list[str]]:
    """Tables of candidates after each of so many alternating passes over the directed pattern, children first, and the tables' prefixes."""
    out, now, names = [], {u: f"{prefix}{u}" for u in order}, [prefix]
    for k in range(passes):
        for u in reversed(order) if k % 2 == 0 else order:
            near = [b for a, b in edges if a == u] if k % 2 == 0 else [a for a, b in edges if b == u]
            out.append(f"{prefix}_p{k}_{u} AS MATERIALIZED (SELECT x.v FROM {now[u]} x WHERE {_hall('x.v', near, lambda w: now[w])})")
            now[u] = f"{prefix}_p{k}_{u}"
        names.append(f"{prefix}_p{k}_")
    return out, names


def hall_tables(pattern: Pattern, rounds: int, prefix: str = "c") -> tuple[list[str], str]:
    """Tables of candidates after so many rounds of neighbourhood matching, and their prefix."""
    out, before = [], prefix
    for r in range(rounds):
        after = f"{prefix}_{r}_"
        for u in pattern.vertices:
            near = pattern.neighbours(u)
            tests = []
            for size in range(1, len(near) + 1):
                for subset in combinations(near, size):
                    union = " UNION ".join(f"SELECT v FROM {before}{w}" for w in subset)
                    tests.append(f"x.v IN (SELECT src FROM adj WHERE dst IN ({union}) GROUP BY src HAVING count(DISTINCT dst) >= {size})")
            out.append(f"{after}{u} AS MATERIALIZED (SELECT x.v FROM {before}{u} x WHERE {' AND '.join(tests) or 'true'})")
        before = after
    return out, before


def matches(pattern: Pattern, induced: bool, prefix: str = "c", upto: list[int] | None = None, loose: int | None = None) -> str:
    """SELECT of m<u> columns: a product of candidates with edges, non-edges and injectivity (not demanded of the vertex ``loose``) as conditions."""
    us = upto or pattern.vertices
    joins, done = [], []
    for u in us:
        links = [v for v in done if pattern.adjacent(u, v)]
        if not done:
            joins.append(f"FROM {prefix}{u} t{u}")
        else:
            if links:
                joins.append(f"JOIN adj a{u} ON a{u}.src = t{links[-1]}.v JOIN {prefix}{u} t{u} ON t{u}.v = a{u}.dst")
            else:
                joins.append(f"CROSS JOIN {prefix}{u} t{u}")
        done.append(u)
    where = []
    for i, u in enumerate(us):
        for v in us[:i]:
            if u != loose:
                where.append(f"t{u}.v <> t{v}.v")
            if pattern.adjacent(u, v):
                where.append(f"EXISTS (SELECT 1 FROM edges WHERE src = least(t{u}.v, t{v}.v) AND dst = greatest(t{u}.v, t{v}.v))")
            elif induced:
                where.append(f"NOT EXISTS (SELECT 1 FROM edges WHERE src = least(t{u}.v, t{v}.v) AND dst = greatest(t{u}.v, t{v}.v))")
    return f"SELECT {', '.join(f't{u}.v AS m{u}' for u in sorted(us))} {' '.join(joins)}" + (f" WHERE {' AND '.join(where)}" if where else "")


def mapping(pattern: Pattern) -> str:
    return " || ".join(f"'{u}->' || m{u} || ';'" for u in pattern.vertices)


def lot(*parts: str) -> str:
    """The first 32 bits of md5 over parts joined by '|'."""
    text = " || '|' || ".join(f"CAST({p} AS VARCHAR)" for p in parts)
    return f"CAST(('0x' || substr(md5({text}), 1, 8)) AS BIGINT)"
