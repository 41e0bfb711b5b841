"""Rank audits and scenario scores over cells."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import aggregates as A
from ..operators import ranking as R
from ..operators import tables as TB
from ..operators import windows as W
from .adapters import adapter, duck
from .calibration import R6


def _cells(spark: SparkSession, d: str) -> DataFrame:
    c = adapter(spark, d, "cells").withColumns({"old": F.round(F.col("density") * 0.6 + F.col("road") * 0.4, 6), "new": F.round(F.col("density") * 0.5 + F.col("svf") * 0.5, 6)})
    return c.withColumn("third", F.round(F.col("old") * 0.8 + F.col("shade") * 0.2, 6))


C = f"{duck('cells')}, b as (select *, round(density * 0.6 + road * 0.4, 6) as old, round(density * 0.5 + svf * 0.5, 6) as new from cells), c as (select *, round(old * 0.8 + shade * 0.2, 6) as third, rank() over (order by old desc) as ro, rank() over (order by new desc) as rn from b), k as (select *, rank() over (order by third desc) as rt from c)"


def _ranks(spark: SparkSession, d: str) -> DataFrame:
    c = _cells(spark, d)
    for score, name in (("old", "ro"), ("new", "rn"), ("third", "rt")):
        c = W.rank_desc(c, score, name)
    return c


def rank_comparison(spark: SparkSession, d: str) -> DataFrame:
    return R.rank_comparison(_cells(spark, d), "cell", "old", "new", 20)


COMPARE = f"{C} select cell, ro as old_rank, rn as new_rank, ro - rn as rank_change, case when ro <= 20 and rn <= 20 then 'stayed' when rn <= 20 then 'entered' when ro <= 20 then 'left' else 'outside' end as status from k"


def spearman(spark: SparkSession, d: str) -> DataFrame:
    return R6(R.spearman(_cells(spark, d), "old", "new"))


SPEARMAN = f"{C}, r as (select ro + (count(*) over (partition by old) - 1) / 2.0 as a, rn + (count(*) over (partition by new) - 1) / 2.0 as b from k) select count(*) as n, round(corr(a, b), 6) as spearman from r"


def topn_overlap(spark: SparkSession, d: str) -> DataFrame:
    return R.topn_overlap(_ranks(spark, d), "cell", ["ro", "rn", "rt"], 20)


_OV = "select '{a}' as a, '{b}' as b, count(*) filter ({a} <= 20 and {b} <= 20) as both, coalesce(string_agg(lpad(cell::varchar, 8, '0'), ',' order by cell) filter ({a} <= 20 and {b} > 20), '') as a_only, coalesce(string_agg(lpad(cell::varchar, 8, '0'), ',' order by cell) filter ({b} <= 20 and {a} > 20), '') as b_only from k"
OVERLAP = f"{C} " + " union all ".join(_OV.format(a=a, b=b) for a, b in (("ro", "rn"), ("ro", "rt"), ("rn", "rt")))


def entering_leaving(spark: SparkSession, d: str) -> DataFrame:
    r = _ranks(spark, d)
    return R.entering_leaving(r.withColumn("rank", F.col("ro")), r.withColumn("rank", F.col("rn")), "cell", "rank", 25)


ENTERING = f"{C} select cell, case when ro <= 25 and rn <= 25 then 'stayed' when rn <= 25 then 'entered' else 'left' end as status from k where ro <= 25 or rn <= 25"


def stacked_top(spark: SparkSession, d: str) -> DataFrame:
    r = _ranks(spark, d)
    return R.stacked_top_n({"old": r.select("cell", F.col("ro").alias("rank")), "new": r.select("cell", F.col("rn").alias("rank"))}, "rank", 15, "cell")


STACKED = f"{C} select * from (select cell, ro as rank, 'old' as scenario from k order by ro, cell limit 15) a union all select * from (select cell, rn as rank, 'new' as scenario from k order by rn, cell limit 15) b"


def transition_fisher(spark: SparkSession, d: str) -> DataFrame:
    r = _ranks(spark, d)
    return R.fisher_exact(r, F.col("ro") <= 20, F.col("park") < 700).withColumns({"p_value": F.round("p_value", 6), "odds_ratio": F.round("odds_ratio", 6)})


_LF = lambda x: f"lgamma({x} + 1)"
_LOGP = lambda k: f"{_LF('r')} + {_LF('n - r')} + {_LF('c')} + {_LF('n - c')} - {_LF('n')} - {_LF(k)} - {_LF(f'r - {k}')} - {_LF(f'c - {k}')} - {_LF(f'n - r - c + {k}')}"
FISHER = f"""{C}, t as (select count(*) filter (ro <= 20 and park < 700) as n11, count(*) filter (ro <= 20 and park >= 700) as n10, count(*) filter (ro > 20 and park < 700) as n01, count(*) filter (ro > 20 and park >= 700) as n00 from k),
 m as (select *, n11 + n10 as r, n11 + n01 as c, n11 + n10 + n01 + n00 as n from t), e as (select *, unnest(range(greatest(0, r + c - n), least(r, c) + 1)) as i from m), p as (select *, exp({_LOGP('i')}) as p, exp({_LOGP('n11')}) as p0 from e)
 select n11, n10, n01, n00, round(least(1, sum(p) filter (p <= p0 * (1 + 1e-7) + 1e-12)), 6) as p_value, round(n11 * n00 / nullif(n10 * n01, 0), 6) as odds_ratio from p group by n11, n10, n01, n00"""


def transitions(spark: SparkSession, d: str) -> DataFrame:
    r = _ranks(spark, d)
    return r.groupBy(R.transition_class(F.col("ro") <= 20, F.col("rn") <= 20, F.col("gvi") < 20).alias("transition")).agg(F.count("*").alias("n"))


TRANSITIONS = f"""{C} select case when ro <= 20 and rn <= 20 then 'old_top_' || m || '_retained_top' when ro <= 20 then 'old_top_' || m || '_left_top' when rn <= 20 and m = 'fp' then 'entering_top_fp_candidate' when rn <= 20 then 'entering_top_nonfp'
 when m = 'fp' then 'fp_candidate_outside_top_transition' else 'other' end as transition, count(*) as n from (select *, case when gvi < 20 then 'fp' else 'nonfp' end as m from k) x group by 1"""


def audit_flags(spark: SparkSession, d: str) -> DataFrame:
    r = _ranks(spark, d).withColumns({"comp": F.when(F.col("cell") % 6 == 0, 0.0).otherwise(F.col("road")), "gain": F.col("svf"), "dgain": F.col("shade") - 0.5})
    return R.audit_flags(r, "ro", "comp", "gain", "density", "dgain").select("cell", "candidate", "audit_flags")


AUDIT = f"""{C}, a as (select *, case when cell % 6 = 0 then 0.0 else road end as comp, ro <= 50 and (cell % 6 = 0 or road <= 0.2) and svf >= 0.5 and density >= 0.05 as candidate from k)
 select cell, candidate, concat_ws(';', case when ro <= 20 then 'old_top20_hazard' when ro <= 50 then 'old_top50_hazard' end, case when comp = 0 then 'zero_old_completeness' when comp <= 0.2 then 'low_old_completeness' end,
  case when svf >= 0.5 then 'high_coverage_gain' end, case when shade - 0.5 >= 0.10 then 'large_building_density_gain' end, case when candidate then 'possible_false_positive' end) as audit_flags from a"""


def density_sanity(spark: SparkSession, d: str) -> DataFrame:
    return R6(R.density_sanity(_cells(spark, d), "density", [0.1, 0.3, 0.6, 0.9], ["svf", "gvi"]))


SANITY = f"{C} select th as threshold, count(*) as n, round(avg(svf), 6) as mean_svf, round(quantile_cont(svf, 0.5), 6) as median_svf, round(avg(gvi), 6) as mean_gvi, round(quantile_cont(gvi, 0.5), 6) as median_gvi from k, unnest([0.1::double, 0.3, 0.6, 0.9]) as t(th) where density >= th group by th"


def mann_whitney(spark: SparkSession, d: str) -> DataFrame:
    o = adapter(spark, d, "obs").filter("kind <> 'error'")
    return R.mann_whitney(o, "y", "kind", "click").withColumn("z", F.round("z", 6))


MANN = f"""{duck('obs')}, r as (select y, kind, rank() over (order by y) + (count(*) over (partition by y) - 1) / 2.0 as m from obs where kind <> 'error'), t as (select sum(power(c, 3) - c) as ties from (select count(*)::double as c from r group by y) x),
 s as (select count(*)::double as n, count(*) filter (kind = 'click')::double as n1, sum(m) filter (kind = 'click') as r1 from r), u as (select *, n - n1 as n2, r1 - n1 * (n1 + 1) / 2 as u from s cross join t)
 select n::bigint as n, n1::bigint as n1, u, round((u - n1 * n2 / 2 - sign(u - n1 * n2 / 2) * 0.5) / sqrt(n1 * n2 / 12 * (n + 1 - ties / (n * (n - 1)))), 6) as z from u"""


def conditioned_risk(spark: SparkSession, d: str) -> DataFrame:
    c = R.candidate_policy(_cells(spark, d), "old", "elderly", "outdoor", (0.5, 0.3, 0.2))
    score = S.conditioned_score(F.col("old"), F.col("elderly"), F.col("outdoor"), F.col("candidate"), (0.6, 0.25, 0.15))
    present = S.weighted_score({"old": 0.5, "svf": 0.5, "absent": 1.0}, c.columns)
    return R6(c.select("cell", "candidate", "policy_score", score.alias("conditioned"), present.alias("weighted")))


CONDITIONED = f"""{C}, q as (select quantile_cont(old, 0.75) as cut from k), m as (select k.*, old >= cut as candidate from k cross join q), e as (select min(old) as lo, max(old) as hi from m where candidate)
 select cell, candidate, round(case when candidate then 0.5 * (old - lo) / (hi - lo) + 0.3 * elderly + 0.2 * outdoor else 0.5 * old end, 6) as policy_score,
 round(case when candidate then 0.6 * old + 0.25 * (old * elderly) + 0.15 * (old * outdoor) else 0.5 * old end, 6) as conditioned, round(least(1, old * 0.5 + svf * 0.5), 6) as weighted from m cross join e"""


def interpretation(spark: SparkSession, d: str) -> DataFrame:
    rules = [("ro <= 50", "hot"), ("ro <= 50 and gvi < 20", "hot_bare"), ("density = 0", "open")]
    return R.interpretation_class(_ranks(spark, d), rules, "background").groupBy("interpretation").agg(F.count("*").alias("n"))


INTERPRETATION = f"{C} select case when density = 0 then 'open' when ro <= 50 and gvi < 20 then 'hot_bare' when ro <= 50 then 'hot' else 'background' end as interpretation, count(*) as n from k group by 1"


def top_vs_all(spark: SparkSession, d: str) -> DataFrame:
    return R6(A.top_vs_all(_ranks(spark, d), "ro", 20, ["svf", "gvi"]))


_TV = "select '{c}' as feature, round(avg({c}), 6) as mean_all, round(quantile_cont({c}, 0.5), 6) as median_all, round(avg({c}) filter (ro <= 20), 6) as mean_top, round(quantile_cont({c}, 0.5) filter (ro <= 20), 6) as median_top from k"
TOP_ALL = f"{C} {_TV.format(c='svf')} union all {_TV.format(c='gvi')}"


def role_delta(spark: SparkSession, d: str) -> DataFrame:
    n = adapter(spark, d, "pixels").withColumn("cell", F.floor(F.col("x") / 20)).withColumn("scenario", F.when(F.col("shaded") == 1, "over").otherwise("base"))
    return R6(A.role_delta(n, "cell", "scenario", "svf", "base", "over", (-0.05, -0.01, 0.01, 0.05)))


ROLE = f"""{duck('pixels')}, p as (select floor(x / 20)::bigint as cell, avg(svf) filter (shaded = 0) as b, avg(svf) filter (shaded = 1) as o from pixels group by 1) select cell, round(b, 6) as base, round(o, 6) as other, round(o - b, 6) as delta,
 case when o - b is null then null when o - b < -0.05 then 'strong_cooling' when o - b < -0.01 then 'cooling' when o - b < 0.01 then 'neutral' when o - b < 0.05 then 'warming' else 'strong_warming' end as delta_class from p"""


def qa_priority(spark: SparkSession, d: str) -> DataFrame:
    r = _ranks(spark, d)
    return R6(TB.qa_priority(r, "land_use", "park", "ro", "cell", [("AUTO", 3.0), ("BUILD", 2.0)], 50).select("cell", "priority"))


QA = f"{C} select cell, round(case when land_use like '%AUTO%' then 3.0 else 0 end + case when land_use like '%BUILD%' then 2.0 else 0 end + least(park / 1000.0, 3.0) + case when ro <= 20 then 2.0 else 0 end, 6) as priority from k order by priority desc, cell limit 50"


def greedy_tiles(spark: SparkSession, d: str) -> DataFrame:
    c = _cells(spark, d).select("cell", "x", "y", F.col("land_use").alias("kind"), "old")
    return R.greedy_diverse_topk(c, "kind", "old", "cell", 5, 500.0)


def diverse_tiles(spark: SparkSession, d: str) -> DataFrame:
    """Tiles of 450 m, 300 m apart, which may overlap by a fifth, with little overhead cover; where a land use has fewer than
    four of these, the limit is relaxed."""
    c = _cells(spark, d).select("cell", "x", "y", F.col("land_use").alias("kind"), "old", F.col("density").alias("overhead"))
    return R.greedy_diverse_topk(c.filter("kind <> 'BUILDING' or overhead > 0.4"), "kind", "old", "cell", 4, 300.0, {"overhead": 0.12}, 450.0)


def _tiles(source: str, k: int, least: float, relax: list[float], limit: str, side: str) -> str:
    """One choice a step: the kind, the round, how many it has, and all tiles chosen so far travel in one row."""
    overlap = f"""greatest({side} - abs(c.x - t.x), 0) * greatest({side} - abs(c.y - t.y), 0)"""
    far = f"sqrt(power(c.x - t.x, 2) + power(c.y - t.y, 2)) >= {least}" + (f" and {overlap} / (2 * {side} * {side} - {overlap}) <= 0.2" if side else "")
    return f"""{source}, names as (select kind, row_number() over (order by kind nulls first) as n from (select distinct kind from c0) u),
 r as (select 1::bigint as n, 1::bigint as round, 0 as taken, [] ::struct(cell bigint, x double, y double)[] as chosen, 0 as step
  union all select case when found is null and r.round = {len(relax)} or found is not null and r.taken + 1 = {k} then r.n + 1 else r.n end, case when found is not null and r.taken + 1 = {k} then 1 when found is not null then r.round when r.round = {len(relax)} then 1 else r.round + 1 end,
   case when found is not null and r.taken + 1 < {k} then r.taken + 1 when found is null and r.round < {len(relax)} then r.taken else 0 end, case when found is null then r.chosen else list_append(r.chosen, found) end, r.step + 1
  from (select r.*, (select {{'cell': c.cell, 'x': c.x, 'y': c.y}} from c0 c join names m on m.kind is not distinct from c.kind where m.n = r.n and {limit} and not list_contains(list_transform(r.chosen, lambda t: t.cell), c.cell)
    and {'(r.round = 4 or ' if len(relax) > 1 else '('} list_bool_and(list_append(list_transform(r.chosen, lambda t: {far}), true))) order by c.old desc, c.cell limit 1) as found from r) r where r.n <= (select count(*) from names))
 select c0.* from (select unnest(chosen).cell as cell from r where step = (select max(step) from r)) z join c0 using (cell)"""


_TILE_CELLS = f"{duck('cells').replace('with ', 'with recursive ', 1)}, c0 as (select cell, x, y, land_use as kind, round(density * 0.6 + road * 0.4, 6) as old"
GREEDY = _tiles(f"{_TILE_CELLS} from cells)", 5, 500.0, [1.0], "true", "")
DIVERSE = _tiles(f"{_TILE_CELLS}, density as overhead from cells where land_use <> 'BUILDING' or density > 0.4)", 4, 300.0, [1.0, 2.5, 5.0, 999.0], "c.overhead <= 0.12::double * ([1.0, 2.5, 5.0, 999.0]::double[])[r.round]", "450.0")

QUERIES = {
    "rank_comparison": (rank_comparison, COMPARE), "spearman": (spearman, SPEARMAN), "topn_overlap": (topn_overlap, OVERLAP), "entering_leaving": (entering_leaving, ENTERING), "stacked_top": (stacked_top, STACKED), "transition_fisher": (transition_fisher, FISHER),
    "transitions": (transitions, TRANSITIONS), "audit_flags": (audit_flags, AUDIT), "density_sanity": (density_sanity, SANITY), "mann_whitney": (mann_whitney, MANN), "conditioned_risk": (conditioned_risk, CONDITIONED), "interpretation": (interpretation, INTERPRETATION),
    "top_vs_all": (top_vs_all, TOP_ALL), "role_delta": (role_delta, ROLE), "qa_priority": (qa_priority, QA), "greedy_tiles": (greedy_tiles, GREEDY), "diverse_tiles": (diverse_tiles, DIVERSE),
}
