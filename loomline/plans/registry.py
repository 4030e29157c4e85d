"""Where queries and the SQL they must agree with are collected, and SQL they share."""

QUERIES: dict = {}
SQL: dict = {}


def query(sql: str | None = None):
    """Register the function as a query under its name, with the SQL it must agree with."""

    def add(f):
        if f.__name__ in QUERIES:
            raise ValueError(f"a query named {f.__name__} is registered already")
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


#: Every row whose id is divisible by 100 asks, so the queries grow with the table.
EVERY = "vec_id % 100 = 0"


def also(*suffixes: str):
    """Keep earlier names of a query, NAME_suffix each; stands above ``query``."""

    def add(f):
        for suffix in suffixes:
            QUERIES[f"{f.__name__}_{suffix}"], SQL[f"{f.__name__}_{suffix}"] = f, SQL[f.__name__]
        return f

    return add


MESSAGES = """m AS (SELECT conv_id * 1000 + turn AS id, conv_id AS thread_id, turn, role, text,
  CASE WHEN turn - CASE WHEN turn % 5 = 4 THEN 2 ELSE 1 END >= 0 THEN conv_id * 1000 + turn - CASE WHEN turn % 5 = 4 THEN 2 ELSE 1 END END AS parent_id FROM conversations)"""
UP = f"""WITH RECURSIVE {MESSAGES}, c AS (SELECT id, parent_id AS ancestor, 1 AS depth FROM m WHERE parent_id IS NOT NULL
  UNION ALL SELECT c.id, m.parent_id, depth + 1 FROM c JOIN m ON c.ancestor = m.id WHERE m.parent_id IS NOT NULL)"""
