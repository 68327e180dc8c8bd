"""DuckDB statements for the training-data queries that SQL can express on whole tables."""

_SIDE = "regexp_replace(lower(coalesce({0}, '')), '[^\\p{{L}}\\p{{N}}]+', '', 'g')"

_COPIES = f"""
WITH k AS (
  SELECT pair_id, {_SIDE.format('kk')} AS a, {_SIDE.format('ru')} AS b FROM pairs
), c AS (
  SELECT pair_id, min(pair_id) OVER w AS first_id, count(*) OVER w AS copies FROM k
  WINDOW w AS (PARTITION BY least(a, b), greatest(a, b))
)
"""

_WORDS = "regexp_extract_all(lower(coalesce({0}, '')), '[\\p{{L}}\\p{{N}}]+')"


def _cells(table: str, row: str) -> str:
    sides = " UNION ALL ".join(f"SELECT {row} AS id, '{c}' AS f, {_WORDS.format(c)} AS w FROM {table}" for c in ("kk", "ru"))
    return f"""SELECT id, f, len(l) AS n, x, row_number() OVER (PARTITION BY id, f, x) AS k
      FROM (SELECT id, f, w AS l, unnest(w) AS x FROM ({sides}) WHERE len(w) >= 10)"""


_OVERLAP = f"""
WITH e AS ({_cells('eval_pairs', 'item_id')}), p AS ({_cells('pairs', 'pair_id')}),
 j AS (SELECT e.id AS item_id, p.id AS pair_id, f, count(*) AS same, any_value(greatest(e.n, p.n)) AS most FROM e JOIN p USING (f, x, k) GROUP BY ALL),
 o AS (SELECT DISTINCT item_id, pair_id FROM j WHERE 5 * same >= 4 * most)
"""

_RUNS = "regexp_extract_all(lower(regexp_replace(coalesce(text, ''), '<[^<>]*>', ' ', 'g')), '[\\p{L}\\p{N}]+')"
_LEAKS = f"""
WITH d AS (SELECT doc_id, {_RUNS} AS w FROM documents), q AS (SELECT passage_id, {_RUNS} AS w FROM test_passages),
 dw AS (SELECT doc_id, unnest([array_to_string(w[i : i + 11], ' ') FOR i IN range(1, len(w) - 10)]) AS r FROM d),
 qw AS (SELECT passage_id, unnest([array_to_string(w[i : i + 11], ' ') FOR i IN range(1, len(w) - 10)]) AS r FROM q),
 h AS (SELECT DISTINCT doc_id, passage_id FROM dw JOIN qw USING (r))
"""

ORACLES = {
    "p4_found": _OVERLAP + "SELECT item_id, pair_id FROM o",
    "p4_per_split_and_origin": _OVERLAP
    + """SELECT split, origin, count(*) AS n_pairs, count(DISTINCT item_id) AS n_items, count(DISTINCT pair_id) AS n_rows
      FROM o JOIN eval_pairs USING (item_id) JOIN (SELECT pair_id, origin FROM pairs) USING (pair_id) GROUP BY split, origin""",
    "p9_found": _LEAKS + "SELECT doc_id, passage_id FROM h",
    "p9_per_passage": _LEAKS + "SELECT passage_id, count(doc_id) AS n_docs FROM test_passages LEFT JOIN h USING (passage_id) GROUP BY passage_id",
    "p5_found": _COPIES + "SELECT first_id, pair_id AS copy_id FROM c WHERE pair_id <> first_id",
    "p5_collapsed": _COPIES + "SELECT pair_id, copies FROM c WHERE pair_id = first_id",
}
