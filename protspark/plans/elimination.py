"""SQL twin of dense solutions: Gauss-Jordan steps as a recursive table, for many symmetric positive definite systems at once."""

#: From ``m0 (g, i, j, n, v)``, rows i and columns j from 0, column n the right side: ``solved (g, i, v)``.
SOLVE_SQL = """el AS (
    SELECT 0 AS k, g, i, j, n, v FROM m0
    UNION ALL
    SELECT k + 1, g, i, j, n, CASE WHEN i = k THEN prow / head ELSE v - pcol * prow / head END FROM (
        SELECT *, max(v) FILTER (WHERE i = k AND j = k) OVER (PARTITION BY g) AS head, max(v) FILTER (WHERE i = k) OVER (PARTITION BY g, j) AS prow,
               max(v) FILTER (WHERE j = k) OVER (PARTITION BY g, i) AS pcol FROM el WHERE k < n)),
    solved AS (SELECT g, i, v FROM el WHERE k = n AND j = n)"""
