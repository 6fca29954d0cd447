"""One surviving record per group of duplicates, by a latent two-sided quality model.

A binary fact (this record is a grant; this group has this code) is claimed by sources of unequal quality. Each
source has a sensitivity (it asserts a true fact) and a specificity (it denies a false one); both, and the
posterior of every fact, come from expectation-maximisation (``two_sided_em``). The model runs on patterns, i.e.
on the distinct combinations of assertions and denials with their counts, so one iteration reads each pattern
once, whatever the number of records.

* ``grant_votes`` / ``grant_quality``: the attributes of a record that speak of its grant are the sources.
* ``survivors``: one row per group of two or more records and field, with the survivor and the record from which
  the field's value comes. Aggregates only, combined before the shuffle, so a hot group costs one row per task.
* ``true_values``: a multi-valued field keeps every value judged true; the export files are the sources.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.text import is_placeholder, last_filled, narrow, split_list, strip, usable_key
from corpusloom.session import cut_lineage

#: Attributes that say something about a grant, in this order, as sources of the model.
GRANT_SOURCES = ("is_granted", "_source", "kind", "document_type")
FIELDS = ("title", "abstract", "cpc_codes", "filing_date")
#: Columns that the choice of a survivor reads; others are left out first, so their names cannot clash.
NEEDED = ("rec_id", *FIELDS, "priority_numbers", "_appno", "_family", *GRANT_SOURCES, "pub_date", "ingested_at")
#: Dates that stand for "no date".
EMPTY_DATES = ("1900-01-01", "9999-12-31", "1970-01-01", "0001-01-01")


def family_key(df: DataFrame) -> Column:
    """``_family``, else the last filled priority number, else ``_appno``, each compared without case, width,
    blanks and punctuation; null if none is usable (such a record is alone)."""
    return F.coalesce(usable_key(df["_family"]), usable_key(last_filled(df["priority_numbers"])), usable_key(df["_appno"]))


def usable(c: Column, kind: str = "string") -> Column:
    """True if the value is neither null, blank nor a placeholder (dates: nor a stand-in date)."""
    if kind == "date":
        return F.coalesce(~c.cast("string").isin(*EMPTY_DATES), F.lit(False))
    return ~is_placeholder(c)


def grant_votes(df: DataFrame) -> dict[str, Column]:
    """Per source +1 (it says grant), -1 (it denies), 0 (it says nothing)."""
    word = lambda c: F.lower(strip(narrow(c)))
    vote = lambda c, yes: F.when(is_placeholder(c), 0).when(yes, 1).otherwise(-1)
    return {
        "is_granted": F.when(df["is_granted"], 1).when(~df["is_granted"], -1).otherwise(0),
        "_source": vote(df["_source"], F.startswith(word(df["_source"]), F.lit("grant"))),
        "kind": vote(df["kind"], F.startswith(word(df["kind"]), F.lit("b"))),
        "document_type": vote(df["document_type"], F.startswith(word(df["document_type"]), F.lit("grant"))),
    }


def two_sided_em(patterns: list[tuple[tuple[int, ...], int]], n_sources: int, iterations: int = 50, smoothing: float = 1.0) -> tuple[float, list[float], list[float], list[float]]:
    """Prior, sensitivities, specificities and the posterior of each pattern. ``patterns``: votes in +1/-1/0 and
    how often they occur. Starts at the majority; additive smoothing keeps all rates inside (0, 1)."""
    post = [0.5 if sum(v) == 0 else (0.9 if sum(v) > 0 else 0.1) for v, _ in patterns]
    prior, sens, spec = 0.5, [0.9] * n_sources, [0.9] * n_sources
    for _ in range(iterations):
        total = sum(n for _, n in patterns)
        prior = (sum(p * n for p, (_, n) in zip(post, patterns)) + smoothing) / (total + 2 * smoothing)
        for s in range(n_sources):
            yes = sum(p * n for p, (v, n) in zip(post, patterns) if v[s] > 0)
            yes_all = sum(p * n for p, (v, n) in zip(post, patterns) if v[s])
            no = sum((1 - p) * n for p, (v, n) in zip(post, patterns) if v[s] < 0)
            no_all = sum((1 - p) * n for p, (v, n) in zip(post, patterns) if v[s])
            sens[s], spec[s] = (yes + smoothing) / (yes_all + 2 * smoothing), (no + smoothing) / (no_all + 2 * smoothing)
        new = []
        for v, _ in patterns:
            a, b = math.log(prior), math.log(1 - prior)
            for s, x in enumerate(v):
                if x:
                    a += math.log(sens[s] if x > 0 else 1 - sens[s])
                    b += math.log(1 - spec[s] if x > 0 else spec[s])
            new.append(1 / (1 + math.exp(max(-700.0, min(700.0, b - a)))))
        done = max((abs(p - q) for p, q in zip(post, new)), default=0.0) < 1e-9
        post = new
        if done:
            break
    return prior, sens, spec, post


def _vote_patterns(df: DataFrame) -> tuple[DataFrame, list]:
    votes = grant_votes(df)
    voted = df.select("*", *[c.cast("int").alias(f"_v_{s}") for s, c in votes.items()])
    names = [f"_v_{s}" for s in GRANT_SOURCES]
    rows = voted.groupBy(*names).count().collect()  # at most 3 ** 4 rows
    return voted, sorted((tuple(r[n] for n in names), r["count"]) for r in rows)


def judged(df: DataFrame) -> DataFrame:
    """Every record with ``grant_posterior`` of the fitted model, ``grant_vote`` (sayings minus denials) and
    ``is_grant``: the model holds it for a grant (posterior above 0.5) and, as the exact check that follows, more
    filled fields say so than deny it. A record that nothing speaks of is no grant."""
    voted, patterns = _vote_patterns(df)
    post = two_sided_em(patterns, len(GRANT_SOURCES))[3] if patterns else []
    names = [f"_v_{s}" for s in GRANT_SOURCES]
    table = df.sparkSession.createDataFrame([(*v, p) for (v, _), p in zip(patterns, post)], ", ".join(f"{n} int" for n in names) + ", grant_posterior double")
    x = voted.join(F.broadcast(table), names, "left")  # at most 81 rows
    vote = sum((F.col(n) for n in names), F.lit(0))
    return x.withColumn("grant_vote", vote).withColumn("is_grant", (F.col("grant_posterior") > 0.5) & (vote > 0)).drop(*names)


def judgements(df: DataFrame) -> DataFrame:
    """One row: records, grants by the model's posterior, grants by the plain majority of the filled fields, and the
    records on which the two differ or the votes are even."""
    p, vote = F.col("grant_posterior") > 0.5, F.col("grant_vote")
    return judged(df.select(*GRANT_SOURCES)).agg(F.count("*").alias("n_records"), F.count_if(p).alias("n_model"), F.count_if(vote > 0).alias("n_majority"), F.count_if(p != (vote > 0)).alias("n_differ"), F.count_if(vote == 0).alias("n_even"))


def grant_quality(df: DataFrame) -> DataFrame:
    """Sensitivity and specificity of each attribute as a witness of the grant, and how often it speaks."""
    _, patterns = _vote_patterns(df)
    prior, sens, spec, _ = two_sided_em(patterns, len(GRANT_SOURCES))
    rows = [(s, sens[i], spec[i], prior, sum(n for v, n in patterns if v[i])) for i, s in enumerate(GRANT_SOURCES)]
    return df.sparkSession.createDataFrame(rows, "witness string, sensitivity double, specificity double, prior double, n_spoken long")


def _order() -> Column:
    """Place of a judged record in its group, smaller first."""
    known = F.when(usable(F.col("pub_date"), "date"), F.unix_date(F.col("pub_date").cast("date")))
    return F.struct(
        (~F.col("is_grant")).cast("tinyint").alias("g"), F.coalesce(-known, F.lit(2**31 - 1)).alias("d"),
        F.coalesce(-F.unix_micros(F.col("ingested_at").cast("timestamp")), F.lit(2**63 - 1)).alias("t"), F.col("rec_id").alias("rec_id"),
    )


def survivors(df: DataFrame) -> DataFrame:
    """(survivor_rec, field_name, from_rec) for each group of two or more records and each of FIELDS.

    Order in a group: grants first, then later pub_date (unknown last), later ingested_at (null last), smaller
    rec_id. ``from_rec`` is the first record in this order whose value is usable; no row if there is none.
    Records without key are alone and give no row; repeated rows of one rec_id count once each.
    """
    df = df.select(*NEEDED)
    x = judged(df).withColumn("_key", family_key(df)).where("_key is not null")
    slim = x.select("_key", _order().alias("o"), *[usable(F.col(f), "date" if f.endswith("_date") else "string").alias(f) for f in FIELDS])
    best = slim.groupBy("_key").agg(F.count("*").alias("n"), F.min("o").alias("first"), *[F.min(F.when(F.col(f), F.col("o"))).alias(f) for f in FIELDS]).where("n > 1")
    one = best.select(F.col("first.rec_id").alias("survivor_rec"), F.explode(F.array(*[F.struct(F.lit(f).alias("field_name"), F.col(f"{f}.rec_id").alias("from_rec")) for f in FIELDS])).alias("r"))
    return one.select("survivor_rec", "r.*").where("from_rec is not null")


def golden_records(df: DataFrame) -> DataFrame:
    """One completed record per group (records without key are groups of one): survivor, size and FIELDS filled
    from the first record with a usable value. ``cpc_codes`` are the codes of the whole group that ``true_values``
    judges true, sorted; only where it judges none, those of the first record."""
    true = true_values(df).groupBy("_key").agg(F.array_join(F.array_sort(F.collect_set("value")), ";;").alias("_codes"))
    df = df.select(*NEEDED)
    key = F.coalesce(family_key(df), F.concat(F.lit("#"), F.col("rec_id").cast("string")))
    x, order = judged(df).withColumn("_key", key), _order()
    kinds = {f: "date" if f.endswith("_date") else "string" for f in FIELDS}
    aggs = [F.min_by(F.col(f), F.when(usable(F.col(f), kinds[f]), order)).alias(f) for f in FIELDS]
    return x.groupBy("_key").agg(F.min(order)["rec_id"].alias("survivor_rec"), F.count("*").alias("n_records"), *aggs).join(true, "_key", "left").withColumn("cpc_codes", F.coalesce("_codes", "cpc_codes")).drop("_key", "_codes")


#: Smoothing of the rates of a source of codes, as (pseudo-counts in favour, pseudo-counts in all). A file seldom lists
#: a code that is not there, so a file without evidence starts at a specificity of 0.9 (9 of 10); whether it lists all
#: that is there is open, so at a sensitivity of 0.5 (2 of 4). With some thousand facts a file neither weighs.
SENSITIVITY_PRIOR, SPECIFICITY_PRIOR = (2.0, 4.0), (9.0, 10.0)


def true_values(df: DataFrame, field: str = "cpc_codes", iterations: int = 40, threshold: float = 0.5, tolerance: float = 1e-4) -> DataFrame:
    """(survivor key group, value, n_for, n_against, posterior) of the values of a multi-valued field judged true.

    Facts are (group, value). A file that has records of the group with this field filled asserts the value if one
    of them lists it and denies it otherwise. Facts are folded to patterns (assert set, deny set) with counts; the
    driver holds one sensitivity and specificity per source. It ends when no rate moves by ``tolerance``. Groups
    without any filled value give no row.
    """
    source = F.concat_ws("/", "_source_folder", "_source_file")
    x = df.select(family_key(df).alias("_key"), F.coalesce(source, F.lit("?")).alias("src"), F.when(usable(F.col(field)), F.array_distinct(split_list(F.col(field)))).alias("vals")).where("_key is not null and size(vals) > 0")
    said = x.select("_key", "src", F.explode("vals").alias("value")).groupBy("_key", "value").agg(F.array_sort(F.collect_set("src")).alias("yes"))
    cover = x.groupBy("_key").agg(F.collect_set("src").alias("all_src"))
    facts = said.join(cover, "_key").select("_key", "value", "yes", F.array_sort(F.array_except("all_src", "yes")).alias("no"))
    facts = cut_lineage(facts)
    pats = cut_lineage(facts.groupBy("yes", "no").agg(F.count("*").alias("n")))
    sens = spec = None
    prior, moved = 0.5, 1.0
    while iterations > 0 and moved >= tolerance:
        iterations -= 1
        scored = pats.select("n", "yes", "no", _posterior(prior, sens, spec).alias("p"))
        said = lambda c, v: F.transform(c, lambda s: F.struct(s.alias("s"), F.lit(v).alias("v")))
        everyone = F.array(F.struct(F.lit(None).cast("string").alias("s"), F.lit(1).alias("v")))  # the prior's own row
        n, p, v = F.col("n"), F.col("p"), F.col("x.v")
        votes = scored.select("n", "p", F.explode(F.concat(everyone, said("yes", 1), said("no", 0))).alias("x"))
        rows = votes.groupBy("x.s").agg(F.sum(n * p * v).alias("tp"), F.sum(n * p).alias("t"), F.sum(n * (1 - p) * (1 - v)).alias("tn"), F.sum(n * (1 - p)).alias("f")).collect()
        if not rows:
            break
        total = next(r for r in rows if r["s"] is None)
        prior = (total["t"] + 1) / (total["t"] + total["f"] + 2)
        up = {r["s"]: (r["tp"] + SENSITIVITY_PRIOR[0]) / (r["t"] + SENSITIVITY_PRIOR[1]) for r in rows if r["s"] is not None}
        down = {r["s"]: (r["tn"] + SPECIFICITY_PRIOR[0]) / (r["f"] + SPECIFICITY_PRIOR[1]) for r in rows if r["s"] is not None}
        moved = max((abs(new[s] - (old or {}).get(s, 0.5)) for new, old in ((up, sens), (down, spec)) for s in new), default=0.0)
        sens, spec = up, down
    pats = pats.withColumn("posterior", _posterior(prior, sens, spec)).select("yes", "no", "posterior")
    out = facts.join(pats, ["yes", "no"]).where(F.col("posterior") > threshold)
    return out.select("_key", "value", F.size("yes").alias("n_for"), F.size("no").alias("n_against"), "posterior")


def _posterior(prior: float, sens: dict | None, spec: dict | None) -> Column:
    """Posterior of a fact from its assert and deny sets. Before the first fit every source weighs the same."""
    if sens is None:
        return (F.size("yes") + 0.5) / (F.size("yes") + F.size("no") + 1.0)
    lit = lambda d: F.create_map(*[F.lit(z) for kv in d.items() for z in kv])
    up = lit({s: math.log(sens[s] / (1 - spec[s])) for s in sens})
    down = lit({s: math.log((1 - sens[s]) / spec[s]) for s in sens})
    odds = F.aggregate("yes", F.lit(math.log(prior / (1 - prior))), lambda a, s: a + F.coalesce(F.element_at(up, s), F.lit(0.0)))
    odds = F.aggregate("no", odds, lambda a, s: a + F.coalesce(F.element_at(down, s), F.lit(0.0)))
    return 1 / (1 + F.exp(-odds))


__all__ = ["family_key", "golden_records", "grant_quality", "judged", "judgements", "survivors", "true_values", "two_sided_em"]
