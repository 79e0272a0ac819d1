"""adl_q1 to adl_q8, ttbar_* and ttgamma_*: event analyses over orders (events) and their lineitems (objects).

An object's pt is its price / 1000, eta (quantity - 25) / 10, phi from the part number, charge from the return flag, mass the tax, b-tag ten times the
discount, flavour from the supplier; missing momentum is the total price / 1000. Photons and muons are lineitems with return flag R and A. The
last bin is open on the right. Derived numbers are rounded to six decimals before cuts and
binning, so that counts are exact.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import ragged as R
from ..functions import vectors as V
from ..functions.elementwise import _let
from ..operators import hist as H
from .arrays import _bin, _r, _rs
from .nested import FIELDS, LI_SQL

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def _fields() -> dict[str, Column]:
    """An object's fields from its lineitem."""
    return {
        "pt": F.col("l_extendedprice") / 1000, "eta": (F.col("l_quantity") - 25) / 10, "phi": (F.col("l_partkey") % 628) / 100.0 - 3.14,
        "charge": F.when(F.col("l_returnflag") == "A", -1).otherwise(1), "mass": F.col("l_tax"), "btag": F.col("l_discount") * 10,
        "flavour": F.col("l_suppkey") % 2, "flag": F.col("l_returnflag"),
    }


def events(spark: SparkSession, sf_dir: str, *names: str, ordered: bool = False) -> DataFrame:
    """k, met, met_phi and, with names, `jets`: lists of structs with these fields, made from the scan before they are grouped, so that no other
    leaf is read or shuffled. ordered: in the order of the lineitems, whose columns then come first in the structs."""
    met = (F.col("o_totalprice") / 1000).alias("met"), ((F.col("o_orderkey") % 628) / 100.0 - 3.14).alias("met_phi")
    all_events = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("k"), *met)
    if not names:
        return all_events
    raw = [F.col(c).alias(f) for f, c in FIELDS.items()] if ordered else []
    made = [c.alias(n) for n, c in _fields().items() if n in names and not (ordered and n in FIELDS)]
    lists = F.collect_list(F.struct(*raw, *made))
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").groupBy("l_orderkey").agg((F.sort_array(lists) if ordered else lists).alias("jets"))
    empty = F.array().cast(dict(lines.dtypes)["jets"])
    return all_events.join(lines, all_events["k"] == lines["l_orderkey"], "left").select("k", "met", "met_phi", F.coalesce("jets", empty).alias("jets"))


OBJ_SQL = f"""{LI_SQL}, j AS (SELECT k, met / 1000 AS met, pos, size, price / 1000 AS pt, (qty - 25) / 10 AS eta, (part % 628) / 100.0::DOUBLE - 3.14::DOUBLE AS phi, (k % 628) / 100.0::DOUBLE - 3.14::DOUBLE AS met_phi,
  CASE WHEN flag = 'A' THEN -1 ELSE 1 END AS charge, tax AS mass, disc * 10 AS btag, supp % 2 AS flavour, flag FROM li),
e AS (SELECT k, met / 1000 AS met FROM ev)"""


def _dphi(a: str, b: str) -> str:
    x = f"({a} - {b} + 3.141592653589793::DOUBLE)"
    return f"({x} - 6.283185307179586::DOUBLE * floor({x} / 6.283185307179586::DOUBLE) - 3.141592653589793::DOUBLE)"


_PAIR = f"round(sqrt(greatest(2 * a.pt * b.pt * (cosh(a.eta - b.eta) - cos({_dphi('a.phi', 'b.phi')})), 0)), 6)"


def _counts(value: str, source: str, bins: int, low: float, high: float) -> str:
    return f"WITH {OBJ_SQL} SELECT t.b AS bin, count(h.b) AS n FROM (SELECT unnest(range({bins})) AS b) t LEFT JOIN (SELECT {_bin(value, bins, low, high, closed=False)} AS b FROM ({source})) h ON h.b = t.b GROUP BY 1"


def _add(name: str, sql: str):
    def put(run):
        QUERIES[name], ORACLE_SQL[name] = run, sql
        return run

    return put


def _shown(df: DataFrame, value: Column, bins: int, low: float, high: float) -> DataFrame:
    return H.histogram(df, F.round(value, 6), bins, low, high, closed_right=False).select("bin", "n")


@_add("adl_q1", _counts("x", "SELECT round(met, 6) AS x FROM e", 50, 0.0, 200.0))
def q1(spark, sf_dir):
    """Missing momentum of all events."""
    return _shown(events(spark, sf_dir), F.col("met"), 50, 0.0, 200.0)


@_add("adl_q2", _counts("x", "SELECT round(pt, 6) AS x FROM j", 50, 0.0, 200.0))
def q2(spark, sf_dir):
    """pt of all jets."""
    return _shown(events(spark, sf_dir, "pt").select(F.explode("jets.pt").alias("pt")), F.col("pt"), 50, 0.0, 200.0)


@_add("adl_q3", _counts("x", "SELECT round(pt, 6) AS x FROM j WHERE abs(eta) < 1", 50, 0.0, 200.0))
def q3(spark, sf_dir):
    """pt of central jets."""
    kept = F.filter("jets", lambda s: F.abs(s["eta"]) < 1)
    return _shown(events(spark, sf_dir, "pt", "eta").select(F.explode(kept).alias("s")), F.col("s.pt"), 50, 0.0, 200.0)


@_add("adl_q4", _counts("x", "SELECT round(any_value(met), 6) AS x FROM j WHERE pt > 40 GROUP BY k HAVING count(*) >= 2", 50, 0.0, 200.0))
def q4(spark, sf_dir):
    """Missing momentum of events with two jets or more above 40."""
    return _shown(events(spark, sf_dir, "pt").where(F.size(F.filter("jets", lambda s: s["pt"] > 40)) >= 2), F.col("met"), 50, 0.0, 200.0)


@_add("adl_q5", _counts("x", f"SELECT round(any_value(a.met), 6) AS x FROM j a JOIN j b ON a.k = b.k AND a.pos < b.pos WHERE a.charge <> b.charge AND {_PAIR} > 60 AND {_PAIR} < 120 GROUP BY a.k", 50, 0.0, 200.0))
def q5(spark, sf_dir):
    """Missing momentum of events with an opposite-charge pair of mass 60 to 120."""
    def good(a: Column, b: Column) -> Column:
        mass = F.round(V.pair_mass(a, b), 6)
        return (a["charge"] != b["charge"]) & F.exists(F.array(mass), lambda m: (m > 60) & (m < 120))

    # a pair has two orders; its charges differ, so the negative one may come first
    charged = lambda q: F.filter("jets", lambda s: s["charge"] == q)
    some = _let(charged(1), lambda others: F.exists(charged(-1), lambda a: F.exists(others, lambda b: good(a, b))))
    return _shown(events(spark, sf_dir, "pt", "eta", "phi", "charge").where(some), F.col("met"), 50, 0.0, 200.0)


_SUMS = {
    name: " + ".join(term.format(o=o) for o in "abc")
    for name, term in {"px": "{o}.pt * cos({o}.phi)", "py": "{o}.pt * sin({o}.phi)", "pz": "{o}.pt * sinh({o}.eta)", "en": "sqrt(pow({o}.pt * cosh({o}.eta), 2) + {o}.mass * {o}.mass)"}.items()
}
_TRIPLES = f"""SELECT k, i, sqrt(px * px + py * py) AS pt, round(sqrt(greatest(en * en - px * px - py * py - pz * pz, 0)), 6) AS m FROM (
  SELECT a.k, (a.pos, b.pos, c.pos) AS i, {_SUMS['px']} AS px, {_SUMS['py']} AS py, {_SUMS['pz']} AS pz, {_SUMS['en']} AS en
  FROM j a JOIN j b ON a.k = b.k AND a.pos < b.pos JOIN j c ON a.k = c.k AND b.pos < c.pos)"""


@_add("adl_q6", _counts("x", f"SELECT round(min_by(pt, (round(abs(m - 172.5::DOUBLE), 6), i)), 6) AS x FROM ({_TRIPLES}) GROUP BY k", 50, 0.0, 300.0))
def q6(spark, sf_dir):
    """pt of the three jets whose mass is nearest 172.5; ties go to the first."""
    p4 = F.transform("jets", lambda s: F.struct(*[c.alias(n) for c, n in zip(V.cartesian_components(s), ("x", "y", "z", "e"), strict=True)]))

    def rated(a: Column, b: Column, c: Column, *places: Column) -> Column:
        x, y, z, e = (a[n] + b[n] + c[n] for n in "xyze")
        total = F.struct(x.alias("x"), y.alias("y"), z.alias("z"), e.alias("e"))
        far = lambda p: F.round(F.abs(F.round(F.sqrt(F.greatest(p["e"] * p["e"] - p["x"] * p["x"] - p["y"] * p["y"] - p["z"] * p["z"], F.lit(0.0))), 6) - 172.5), 6)
        return _let(total, lambda p: F.struct(far(p).alias("far"), *[i.alias(f"i{n}") for n, i in enumerate(places)], p["x"].alias("x"), p["y"].alias("y")))

    rest = lambda c, i: F.slice(c, i + 2, F.size(c))
    third = lambda p, a, i, b, j: F.transform(rest(p, i + j + 1), lambda c, k: rated(a, b, c, i, j, k))
    second = lambda p, a, i: F.flatten(F.transform(rest(p, i), lambda b, j: third(p, a, i, b, j)))
    best = _let(p4, lambda p: F.array_min(F.flatten(F.transform(p, lambda a, i: second(p, a, i)))))
    found = events(spark, sf_dir, "pt", "eta", "phi", "mass", ordered=True).where(F.size("jets") >= 3).select(best.alias("best"))
    return _shown(found, F.sqrt(F.col("best.x") * F.col("best.x") + F.col("best.y") * F.col("best.y")), 50, 0.0, 300.0)


_DR = f"round(sqrt(pow(a.eta - b.eta, 2) + pow({_dphi('a.phi', 'b.phi')}, 2)), 6)"


@_add("adl_q7", _counts("x", f"SELECT round(coalesce(sum(s.pt), 0), 6) AS x FROM e LEFT JOIN (SELECT a.k, a.pt FROM j a LEFT JOIN j b ON a.k = b.k AND b.flag = 'R' AND b.pt > 10 AND {_DR} <= 0.4 WHERE a.flag <> 'R' AND a.pt > 30 AND b.k IS NULL) s ON s.k = e.k GROUP BY e.k", 50, 0.0, 400.0))
def q7(spark, sf_dir):
    """Sum of the pt of jets above 30 with no lepton (return flag R, above 10) within 0.4."""
    leptons = F.filter("jets", lambda s: (s["flag"] == "R") & (s["pt"] > 10))
    # most pairs are apart in eta alone
    apart = lambda s, others: F.forall(others, lambda t: (F.abs(s["eta"] - t["eta"]) > 0.5) | (F.round(V.delta_r(s["eta"], s["phi"], t["eta"], t["phi"]), 6) > 0.4))
    jets = _let(leptons, lambda others: F.filter("jets", lambda s: (s["flag"] != "R") & (s["pt"] > 30) & apart(s, others)))
    return _shown(events(spark, sf_dir, "pt", "eta", "phi", "flag"), R.sum(F.transform(jets, lambda s: s["pt"])), 50, 0.0, 400.0)


@_add("adl_q8", _counts("x", f"""SELECT round(sqrt(2 * l.pt * l.met * (1 - cos({_dphi('l.phi', 'l.met_phi')}))), 6) AS x FROM (
    SELECT k, min_by((i1, i2), (far, i1, i2)) AS best FROM (SELECT a.k, a.pos AS i1, b.pos AS i2, round(abs({_PAIR} - 91.2::DOUBLE), 6) AS far FROM j a JOIN j b ON a.k = b.k AND a.pos < b.pos WHERE a.size >= 3 AND a.charge <> b.charge AND a.flavour = b.flavour) GROUP BY k) p
  JOIN LATERAL (SELECT pt, phi, met, met_phi FROM j WHERE j.k = p.k AND j.pos <> p.best[1] AND j.pos <> p.best[2] ORDER BY pt DESC, pos LIMIT 1) l ON true""", 50, 0.0, 200.0))
def q8(spark, sf_dir):
    """Transverse mass of the missing momentum and the hardest lepton outside the best same-flavour opposite-charge pair."""
    numbered = F.transform("jets", lambda s, i: F.struct(i.alias("i"), *[s[c].alias(c) for c in ("pt", "eta", "phi", "charge", "flavour")]))
    fits = lambda a, c: F.filter(F.slice(c, a["i"] + 2, F.size(c)), lambda b: (a["charge"] != b["charge"]) & (a["flavour"] == b["flavour"]))
    far = lambda a, b: F.round(F.abs(F.round(V.pair_mass(a, b), 6) - 91.2), 6)
    rated = lambda a, c: F.transform(fits(a, c), lambda b: F.struct(far(a, b).alias("far"), a["i"].alias("i"), b["i"].alias("j")))
    lead = lambda c, best: F.array_max(
        F.transform(F.filter(c, lambda s: (s["i"] != best["i"]) & (s["i"] != best["j"])), lambda s: F.struct(s["pt"].alias("pt"), (-s["i"]).alias("i"), s["phi"].alias("phi")))
    )
    chosen = _let(numbered, lambda c: _let(F.array_min(F.flatten(F.transform(c, lambda a: rated(a, c)))), lambda best: F.when(best.isNotNull(), lead(c, best))))
    jets = events(spark, sf_dir, "pt", "eta", "phi", "charge", "flavour", ordered=True).where(F.size("jets") >= 3)
    df = jets.select("met", "met_phi", chosen.alias("lead")).where("lead is not null")
    return _shown(df, V.transverse_mass(F.col("lead.pt"), F.col("lead.phi"), F.col("met"), F.col("met_phi")), 50, 0.0, 200.0)


#: Name: scale of pt, factor of the weight per jet.
VARIATIONS = {"nominal": (1.0, 1.0), "jes_up": (1.05, 1.0), "jes_down": (0.95, 1.0), "btag_up": (1.0, 1.03), "btag_down": (1.0, 0.97)}
_V_SQL = ", ".join(f"('{k}', {s!r}::DOUBLE, {f!r}::DOUBLE)" for k, (s, f) in VARIATIONS.items())


def _varied(df: DataFrame, table: dict[str, tuple[float, float]]) -> DataFrame:
    """Every event once per variation: one job and one plan size for any number of them."""
    return df.withColumn("v", F.explode(F.array(*[F.struct(F.lit(k).alias("name"), F.lit(s).alias("scale"), F.lit(f).alias("factor")) for k, (s, f) in table.items()])))


#: Region: how its number of tagged jets (above TAG) is chosen, in Spark and SQL.
REGIONS = {"4j1b": (lambda n: n == 1, "= 1"), "4j2b": (lambda n: n >= 2, ">= 2")}
TAG = 0.7


def _ttbar(region: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = _varied(events(spark, sf_dir, "pt", "btag").where(F.size("jets") >= 4), VARIATIONS)
        scaled = F.transform("jets", lambda s: F.struct(F.round(s["pt"] * F.col("v.scale"), 6).alias("pt"), s["btag"].alias("btag")))
        # one pass over the jets above 25: how many, how many tagged, the sum of pt, the product of weights
        start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("tags"), F.lit(0.0).alias("ht"), F.lit(1.0).alias("w"))
        add = lambda a, s: F.struct(
            (a["n"] + 1).alias("n"), (a["tags"] + (s["btag"] > TAG).cast("int")).alias("tags"), (a["ht"] + s["pt"]).alias("ht"), (a["w"] * ((F.lit(0.95) + 0.10 * s["btag"]) * F.col("v.factor"))).alias("w")
        )
        df = df.select(F.col("v.name").alias("variation"), F.aggregate(F.filter(scaled, lambda s: s["pt"] > 25), start, add).alias("e"))
        filled = df.where((F.col("e.n") >= 4) & REGIONS[region][0](F.col("e.tags"))).select("variation", F.round("e.ht", 6).alias("ht"), F.col("e.w").alias("w"))
        return H.histograms_by(filled, "variation", F.col("ht"), 40, 0.0, 800.0, F.col("w"), closed_right=False).select("variation", "bin", "n", _r(F.col("sumw"), 6).alias("sumw"))

    return run


def _ttbar_sql(region: str) -> str:
    return f"""WITH {OBJ_SQL}, s AS (SELECT name AS variation, k, round(pt * scale, 6) AS pt, btag, (0.95::DOUBLE + 0.10::DOUBLE * btag) * factor AS w FROM j, (VALUES {_V_SQL}) v(name, scale, factor)),
h AS (SELECT variation, round(sum(pt), 6) AS ht, product(w) AS w FROM s WHERE pt > 25 GROUP BY variation, k HAVING count(*) >= 4 AND count(*) FILTER (btag > {TAG}::DOUBLE) {REGIONS[region][1]})
SELECT variation, b AS bin, count(*) AS n, {_rs('sum(w)', 6)} AS sumw FROM (SELECT *, {_bin('ht', 40, 0.0, 800.0, closed=False)} AS b FROM h) WHERE b IS NOT NULL GROUP BY 1, 2"""


for _region in REGIONS:
    _add(f"ttbar_{_region}", _ttbar_sql(_region))(_ttbar(_region))

PHOTONS = {"nominal": (1.0, 0.98), "jes_up": (1.05, 0.98), "jes_down": (0.95, 0.98), "pho_up": (1.0, 1.01), "pho_down": (1.0, 0.95)}
_P_SQL = ", ".join(f"('{k}', {s!r}::DOUBLE, {f!r}::DOUBLE)" for k, (s, f) in PHOTONS.items())


@_add("ttgamma", f"""WITH {OBJ_SQL}, s AS (SELECT name AS variation, factor, k, flag, pos, round(CASE WHEN flag = 'N' THEN pt * scale ELSE pt END, 6) AS pt FROM j, (VALUES {_P_SQL}) v(name, scale, factor)),
h AS (SELECT variation, k, any_value(factor) AS w, min_by(pt, pos) FILTER (flag = 'R' AND pt > 20) AS lead FROM s GROUP BY variation, k
  HAVING count(*) FILTER (flag = 'N' AND pt > 25) >= 2 AND count(*) FILTER (flag = 'A' AND pt > 30) >= 1 AND lead IS NOT NULL)
SELECT variation, b AS bin, count(*) AS n, {_rs('sum(w)', 6)} AS sumw FROM (SELECT *, {_bin('lead', 30, 0.0, 300.0, closed=False)} AS b FROM h) WHERE b IS NOT NULL GROUP BY 1, 2""")
def ttgamma(spark, sf_dir):
    """pt of the first photon above 20 of events with a muon above 30 and two jets (return flag N) above 25, weighted by the photons' scale factor."""
    photons = F.filter("jets", lambda s: (s["flag"] == "R") & (F.round(s["pt"], 6) > 20))
    muon = F.exists("jets", lambda s: (s["flag"] == "A") & (F.round(s["pt"], 6) > 30))
    df = events(spark, sf_dir, "pt", ordered=True).where(F.size("jets") >= 4).where(muon).withColumn("lead", F.round(F.get(photons, F.lit(0))["pt"], 6)).where("lead is not null")
    jets = F.filter("jets", lambda s: (s["flag"] == "N") & (F.round(s["pt"] * F.col("v.scale"), 6) > 25))
    df = _varied(df, PHOTONS).where(F.size(jets) >= 2)
    return H.histograms_by(df.select(F.col("v.name").alias("variation"), "lead", F.col("v.factor").alias("w")), "variation", F.col("lead"), 30, 0.0, 300.0, F.col("w"), closed_right=False).select("variation", "bin", "n", _r(F.col("sumw"), 6).alias("sumw"))
