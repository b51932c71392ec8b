"""Fragments shared by the SQL twins."""

from lotwise.sources.tables import DOCS, EMB, ITEMS, LOTS, SCORES  # noqa: F401


def r6(x: str) -> str:
    return f"(round(CAST({x} AS DOUBLE) + 1e-10, 6) + 0.0e0)"


def wilson(k: str, n: str) -> tuple[str, str, str]:
    p = f"(CAST({k} AS DOUBLE)/nullif({n},0))"
    den = f"(1+1.96e0*1.96e0/nullif({n},0))"
    mid = f"(({p}+1.96e0*1.96e0/(2*nullif({n},0)))/{den})"
    half = f"(1.96e0*sqrt({p}*(1-{p})/nullif({n},0)+1.96e0*1.96e0/(4.0e0*nullif({n},0)*nullif({n},0)))/{den})"
    lo = f"CASE WHEN {n} > 0 THEN greatest(0.0e0, {mid}-{half}) ELSE 0.0e0 END"
    hi = f"CASE WHEN {n} > 0 THEN least(1.0e0, {mid}+{half}) ELSE 1.0e0 END"
    return p, lo, hi


def band(p: str) -> str:
    return f"(CASE WHEN {p} IS NULL THEN 'unsure' WHEN {p} < 0.05e0 THEN 'clean' WHEN {p} <= 0.2e0 THEN 'some' ELSE 'many' END)"


def verdict(source: str, keys: str, code: str = "code", handfuls: str = "1") -> str:
    """Text of a SELECT that gives the lot verdict of ``source`` per ``keys``."""
    p, lo, hi = wilson("defects", "answered")
    by = f"{keys}, " if keys else ""
    group = f"GROUP BY {keys}" if keys else ""
    return f"""
 SELECT *, CASE WHEN reason <> '' THEN FALSE ELSE {band('lo')} <> {band('p')} OR {band('hi')} <> {band('p')} END AS about,
   CASE WHEN reason <> '' THEN 'unsure' ELSE {band('p')} END AS band FROM (
 SELECT *, {p} AS p, {lo} AS lo, {hi} AS hi,
   CASE WHEN answered = 0 THEN 'too_many_unsure' WHEN CAST(defects AS DOUBLE)/answered > 0.6e0 THEN 'implausible'
        WHEN CAST(unsure AS DOUBLE)/total > 0.15e0 THEN 'too_many_unsure' ELSE '' END AS reason,
   CASE WHEN total > 0 THEN CAST(unsure AS DOUBLE)/total ELSE 1.0e0 END AS unsure_frac FROM (
 SELECT {by}count(*) AS total, count(*) FILTER (WHERE {code} = 0) AS good, count(*) FILTER (WHERE {code} = 1) AS defects,
   count(*) FILTER (WHERE {code} = 2) AS unsure, count(*) FILTER (WHERE {code} <> 2) AS answered, {handfuls} AS handfuls FROM {source} {group}))"""
