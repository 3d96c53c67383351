"""Linear probes on embeddings and on composition."""

from __future__ import annotations

from itertools import product

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.functions.loci import hash_draw
from strandloom.operators.cluster import connected_components
from strandloom.operators.metrics import auroc
from strandloom.operators.sequences import kmer_counts
from strandloom.operators.similarity import similarity_links
from strandloom.session import cut


def probe_scores(df: DataFrame, *, max_iter: int = 30) -> DataFrame:
    """``id, y, score`` of test rows from a logistic regression fitted on the
    others (M12). Input: ``id, embedding, y, test``."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector, vector_to_array

    v = df.select("id", "y", "test", array_to_vector(F.col("embedding").cast("array<double>")).alias("features"))
    model = LogisticRegression(labelCol="y", maxIter=max_iter, regParam=0.01).fit(v.where("NOT test"))
    return model.transform(v.where("test")).select("id", "y", vector_to_array("probability")[1].alias("score"))


def composition_probe(df: DataFrame, *, id_col: str, seq_col: str, label: str, k: int, folds: int, seed: str, max_iter: int = 30) -> DataFrame:
    """``id, y, fold, score`` (M11): logistic regressions on k-mer frequencies, each row
    scored by the model of the folds it isn't in. Folds are hashes of the id."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector, vector_to_array

    mers = ["".join(p) for p in product("ACGT", repeat=k)]
    found = F.map_from_entries("_k")
    total = F.aggregate("_k", F.lit(0.0), lambda a, x: a + x["n"])
    vector = array_to_vector(F.array(*[F.coalesce(F.col("_m")[m] / F.col("_t"), F.lit(0.0)) for m in mers]))
    fold = hash_draw(seed, F.col(id_col)) % folds
    counted = kmer_counts(df.select(F.col(id_col).alias("id"), F.col(label).cast("int").alias("y"), fold.alias("fold"), F.col(seq_col).alias("_s")), seq_col="_s", k=k, name="_k").where(F.size("_k") > 0)
    rows = cut(counted.select("id", "y", "fold", found.alias("_m"), total.alias("_t")).select("id", "y", "fold", vector.alias("features")))
    out = None
    for f in range(folds):
        model = LogisticRegression(labelCol="y", maxIter=max_iter, regParam=0.01).fit(rows.where(F.col("fold") != f))
        got = model.transform(rows.where(F.col("fold") == f)).select("id", "y", "fold", vector_to_array("probability")[1].alias("score"))
        out = got if out is None else out.unionByName(got)
    return out


def separability(auroc_row: DataFrame, *, bands: float = 2.0, clear: float = 0.8) -> DataFrame:
    """Adds ``verdict`` (M11): ``clear`` from a fixed AUROC on, ``detectable`` beyond
    so many null standard errors from one half, else ``none``. A stated rule of this
    library; ``probe_verdict`` has the one for probes with an interval."""
    a = F.col("auroc")
    return auroc_row.withColumn("verdict", F.when(a >= clear, "clear").when(a > 0.5 + bands * F.col("null_se"), "detectable").otherwise("none"))


def probe_verdict(interval: DataFrame, *, auroc: str = "auroc", lower: str = "lo", chance: float = 0.5) -> DataFrame:
    """Adds ``verdict`` (M12): ``PASS`` if the interval's lower end is above chance,
    ``borderline`` if only the estimate is, ``FAIL`` at or below chance or unmeasured."""
    known = lambda c: c.isNotNull() & ~F.isnan(c)
    a, lo = F.col(auroc).cast("double"), F.col(lower).cast("double")
    return interval.withColumn("verdict", F.when(~known(a) | (a <= chance), "FAIL").when(known(lo) & (lo > chance), "PASS").otherwise("borderline"))


def quantile_codes(df: DataFrame, *, embedding: str, levels: int = 4, error: float = 0.001) -> DataFrame:
    """Adds ``codes``: each dimension's quantile class, from approximate quantiles of the
    whole table, ``levels - 1`` numbers a dimension."""
    n = df.select(F.size(embedding).alias("n")).first()
    if n is None:
        return df.withColumn("codes", F.array().cast("array<int>"))
    cuts = df.agg(*(F.percentile_approx(F.col(embedding)[i], [k / levels for k in range(1, levels)], int(1 / error)).alias(f"q{i}") for i in range(n["n"]))).first()
    code = lambda i: sum((F.when(F.col(embedding)[i] > float(c), 1).otherwise(0) for c in cuts[f"q{i}"]), F.lit(0))
    return df.withColumn("codes", F.array(*(code(i).cast("int") for i in range(n["n"]))))


def similarity_groups(df: DataFrame, *, id_col: str, embedding: str, identity: float = 0.8) -> DataFrame:
    """``id, group``: components of embeddings whose quantile classes agree in at least
    ``identity`` of the dimensions (M12), named by their smallest id; ids are integers."""
    links = similarity_links(quantile_codes(df, embedding=embedding), id_col=id_col, codes="codes", identity=identity, coverage=1.0)
    found = connected_components(links).select(F.col("node").alias(id_col), "component")
    return df.select(id_col).join(found, id_col, "left").select(id_col, F.coalesce("component", F.col(id_col).cast("long")).alias("group"))


def grouped_split(groups: DataFrame, *, group: str, share: float, seed: str) -> DataFrame:
    """Adds ``test``: whole groups by a hash of their name, about ``share`` of them."""
    return groups.withColumn("test", hash_draw(seed, F.col(group)) % 10_000 < int(share * 10_000))


def arm_mismatches(decoy: DataFrame, control: DataFrame, hosts: DataFrame) -> DataFrame:
    """One row of counts and ``arms_matched`` (M11), from the windows themselves. Arms have
    ``pair, host_id, phase, insert_len, lo, hi, sequence``, the insert at ``[lo, hi)`` from 0;
    hosts have ``host_id, sequence``. Matched means: every pair has both, of one geometry
    and length, equal outside the insert and different inside, and the control was
    really spliced, which only its host can tell. Empty arms never match."""
    fields = ("host_id", "phase", "insert_len", "lo", "hi", "sequence")
    side = lambda df, p: df.select("pair", *(F.col(c).alias(f"{p}{c}") for c in fields), F.lit(True).alias(f"{p}here"))
    both = side(decoy, "d_").join(side(control, "c_"), "pair", "full").join(hosts.select(F.col("host_id").alias("c_host_id"), F.col("sequence").alias("host")), "c_host_id", "left")
    col = F.col
    paired = col("d_here") & col("c_here")
    geometry = paired & col("d_host_id").eqNullSafe(col("c_host_id")) & col("d_phase").eqNullSafe(col("c_phase")) & col("d_insert_len").eqNullSafe(col("c_insert_len"))
    fit = geometry & (F.length("d_sequence") == F.length("c_sequence"))
    part = lambda s, a, n: F.substr(col(s), a, n)
    inside = lambda s: part(s, col("d_lo") + 1, col("d_hi") - col("d_lo"))
    outside = lambda s: F.concat(part(s, F.lit(1), col("d_lo")), F.lit("|"), part(s, col("d_hi") + 1, F.length(s)))
    n = lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    counts = both.agg(
        n(paired).alias("n_pairs"), n(F.coalesce(~paired, F.lit(True))).alias("n_unpaired"), n(paired & ~geometry).alias("n_geometry_mismatch"), n(geometry & ~fit).alias("n_length_mismatch"),
        n(fit & (outside("d_sequence") != outside("c_sequence"))).alias("n_flank_mismatch"), n(fit & (inside("d_sequence") == inside("c_sequence"))).alias("n_identical_inside"),
        n(fit & col("host").isNull()).alias("n_host_unresolved"), n(fit & (inside("host") == inside("c_sequence"))).alias("n_control_unspliced"),
    )
    bad = [c for c in counts.columns if c != "n_pairs"]
    return counts.withColumn("arms_matched", (col("n_pairs") > 0) & (sum((col(c) for c in bad), F.lit(0)) == 0))


def junction_measurement(
    plain: DataFrame, null_reference: DataFrame, control: DataFrame, decoy: DataFrame, matched_control: DataFrame, hosts: DataFrame, *, k: int, folds: int, seed: str, sigma: float = 3.0,
) -> DataFrame:
    """One row (M11): AUROCs of cross-validated k-mer probes between unspliced windows and
    others (the null), between controls and unspliced windows (the junction), and between
    decoys and controls (the content); whether the paired arms match; and the clauses:
    ``probe_can_discriminate`` if the content deviates from one half by more than the
    null's deviation and ``sigma`` null standard errors, ``junction_within_null_band`` if
    the junction does not, ``decoy_beats_junction`` if content deviates more than junction.
    Every clause is false where an arm is empty.

    ``plain`` and ``null_reference`` have ``id, sequence``, the others are arms as in
    ``arm_mismatches``. A sequence in both null arms and a host in both ``control`` and
    ``decoy`` are errors: either would bend the comparison."""
    if not plain.join(null_reference, "sequence", "left_semi").isEmpty():
        raise ValueError("sequences are in both null arms")
    if not control.join(decoy, "host_id", "left_semi").isEmpty():
        raise ValueError("hosts are in both the control and the decoy arm")

    def rows(df: DataFrame, tag: str, y: int) -> DataFrame:
        key = "id" if "id" in df.columns else "pair"
        return df.select(F.concat(F.lit(f"{tag}:"), F.col(key).cast("string")).alias("id"), F.col("sequence").alias("seq"), F.lit(y).alias("y"))

    out = arm_mismatches(decoy, matched_control, hosts)
    for name, (one, other) in (("null", (plain, null_reference)), ("junction", (control, plain)), ("content", (decoy, control))):
        if one.isEmpty() or other.isEmpty():
            out = out.withColumn(f"auroc_{name}", F.lit(None).cast("double")).withColumn(f"se_{name}", F.lit(None).cast("double"))
            continue
        scores = composition_probe(rows(one, "a", 1).unionByName(rows(other, "b", 0)), id_col="id", seq_col="seq", label="y", k=k, folds=folds, seed=seed)
        out = out.join(auroc(scores, score="score", label="y").select(F.col("auroc").alias(f"auroc_{name}"), F.col("null_se").alias(f"se_{name}")), F.lit(True))
    away = lambda c: F.abs(F.col(c) - 0.5)
    band = away("auroc_null") + sigma * F.col("se_null")
    present = F.col("auroc_null").isNotNull() & F.col("auroc_junction").isNotNull() & F.col("auroc_content").isNotNull() & F.col("se_null").isNotNull()
    clause = lambda c: present & F.coalesce(c, F.lit(False))
    return out.select(
        "*", present.alias("measured"), clause(away("auroc_content") > band).alias("probe_can_discriminate"), clause(away("auroc_junction") <= band).alias("junction_within_null_band"),
        clause(away("auroc_content") > away("auroc_junction")).alias("decoy_beats_junction"),
    )
