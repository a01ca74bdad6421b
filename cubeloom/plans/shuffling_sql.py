"""Shuffles in SQL: places are walked by recursion until all are within."""

from __future__ import annotations


def rounds(x: str, key: str) -> str:
    """``pl`` from a number by six nested queries, each of which turns one pair of digits into the next."""
    q = f"SELECT *, {x} // a AS l, {x} % a AS r FROM src"
    for k in range(1, 7):
        q = f"SELECT * EXCLUDE (l, r), r AS l, (l + (((((r + {k} * 40503 + {key} * 7919) * 2654435761) % 4294967296) // 256 * 1540483477) % 4294967296) // 64) % a AS r FROM ({q})"
    return f"SELECT * EXCLUDE (l, r), l * a + r AS pl FROM ({q})"


def shuffled(items: str, select: str) -> str:
    """``items`` are ``i, n, key`` and what else is kept."""
    return f"""WITH RECURSIVE hh AS (SELECT max(l_orderkey) // 4 // 64 + 1 AS height FROM lineitem), items AS ({items}),
      sized AS (SELECT *, CAST(floor(sqrt(CAST(n - 1 AS DOUBLE))) AS BIGINT) + 1 AS a FROM items),
      walk AS ({rounds("i", "key").replace("FROM src", "FROM sized")} UNION ALL
        SELECT * EXCLUDE (pl, nx), nx AS pl FROM ({rounds("pl", "key").replace("FROM src", "FROM (SELECT * FROM walk WHERE pl >= n)").replace("SELECT * EXCLUDE (l, r), l * a + r AS pl", "SELECT * EXCLUDE (l, r), l * a + r AS nx")}))
      {select} FROM walk WHERE pl < n"""


SQL = {
    "shuffled_batches": shuffled(
        "SELECT ci, cj, epoch AS key, ci * 4 + cj AS i, height // 16 * 4 AS n FROM hh, (SELECT unnest(range(3)) AS epoch), (SELECT unnest(range(4)) AS cj), (SELECT unnest(range(height // 16)) AS ci FROM hh)",
        "SELECT CAST(key AS INTEGER) AS epoch, pl // 8 AS batch, pl % 8 AS slot, ci, cj",
    ),
    "shuffled_pixels": shuffled("SELECT 42 AS key, height * 64 AS n, unnest(range(height * 64)) AS i FROM hh", "SELECT i AS pid, pl AS place"),
}
