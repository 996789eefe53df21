"""Named queries over the provided tables."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from statewalk import config
from statewalk.functions.labels import standardize_group
from statewalk.functions.stats import adjusted_rand_index, normalize_probability
from statewalk.model import match, select
from statewalk.model.chunks import Chunks, chunk_table
from statewalk.model.decode import decoded_labels, decoded_rows
from statewalk.model.fit import fit_starts, fit_table, model_of
from statewalk.model.journal import Journal
from statewalk.model.start import planned_starts
from statewalk.operators import graph, matrices, occupancy, runs, sojourn, transitions, validate
from statewalk.plans import given_model, views
from statewalk.session import fingerprint, materialize, shared_dir
from statewalk.sinks.tables import Output
from statewalk.sources.tables import read_decoded, state_correlations

K = views.EVENT_K
SEQUENCE_WIDTH = config.DURATION_CAP
DIGITS = 6

_hubs: dict[tuple, str] = {}


def presentable(df: DataFrame, digits: int = DIGITS) -> DataFrame:
    """Result form: integers as bigint, doubles rounded (the rounded table copies)."""
    columns = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.IntegerType, T.ShortType, T.ByteType)):
            c = c.cast("bigint")
        elif isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            c = F.round(c.cast("double"), digits) + F.lit(0.0)
        columns.append(c.alias(f.name))
    return df.select(*columns)


def hub(spark: SparkSession, sf_dir: str, name: str, build: Callable[[], DataFrame]) -> DataFrame:
    """Hub tables are written once per application and state of the data folder, and shared by the
    queries that start from them, as the pipeline's stages share the decoded table."""
    key = (spark.sparkContext.applicationId, sf_dir, fingerprint(spark, sf_dir), name)
    if key not in _hubs:
        df = materialize(build(), name)
        _hubs[key] = df.inputFiles()[0].rsplit("/", 1)[0] if df.inputFiles() else ""
        return df
    if _hubs[key]:
        return spark.read.parquet(_hubs[key])
    return build()


def decoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hub(spark, sf_dir, "decoded", lambda: views.decoded_events(spark, sf_dir))


def _complete(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hub(
        spark, sf_dir, "complete_runs",
        lambda: runs.complete_runs(runs.state_runs(decoded(spark, sf_dir))),
    )


def _occupancy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hub(
        spark, sf_dir, "occupancy", lambda: occupancy.subject_occupancy(decoded(spark, sf_dir), K)
    )


def _counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hub(
        spark, sf_dir, "transition_counts",
        lambda: transitions.subject_counts(decoded(spark, sf_dir), K),
    )


def _subjects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validate.subject_information(decoded(spark, sf_dir))


def _mixed_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey") % 12
    labels = F.array(*[F.lit(g) for g in views.RAW_GROUPS])
    raw = F.when(key < 10, F.get(labels, key.cast("int"))).otherwise(F.col("c_mktsegment"))
    return (
        views.table(spark, sf_dir, "customer").select(raw.alias("raw_label"))
        .groupBy("raw_label", standardize_group(F.col("raw_label")).alias("group"))
        .agg(F.count(F.lit(1)).alias("n_rows"))
    )


def _faulty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decoded rows with known faults: shifted time, mixed groups, two files."""
    user = F.col("user_id")
    placed = views.ordered_index(
        views.table(spark, sf_dir, "events").select("user_id", "ts", "event_id"),
        "user_id", ["ts", "event_id"],
        {"day": F.col("ts").cast("date"), "second": views._seconds(F.col("ts"))},
    )
    mixed = (user % 2 == 0) | ((user % 7 == 3) & (F.col("event_id") % 5 == 0))
    return placed.select(
        user.alias("subject_id"),
        F.when(mixed, F.lit("TD")).otherwise(F.lit("Dyslexia")).alias("group"),
        F.concat(
            F.lit("user_"), F.when(user % 11 == 2, F.col("event_id") % 2).otherwise(user)
        ).alias("file"),
        (F.col("timepoint") + F.when(user % 5 == 1, 1).otherwise(0)).alias("timepoint"),
    )


def _labeling_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Agreement of the event states with a second labeling by value."""
    other = F.least(F.lit(5), F.greatest(F.lit(1), 1 + F.floor(F.col("value") / 20)))
    both = views.table(spark, sf_dir, "events").select(
        views.event_state(F.col("event_type")).alias("state"), other.alias("other")
    )
    return adjusted_rand_index(both, "state", "other")


def _decoded_from_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The decoded table after a trip through CSV with messy labels and fractional ids."""
    messy = decoded(spark, sf_dir).select(
        (F.col("subject_id") + 0.25).alias("subject_id"),
        views.raw_group(F.col("subject_id")).alias("group"), "file", "timepoint",
        (F.col("state") + 0.5).alias("state"),
    )
    path = f"{shared_dir(spark)}/decoded-csv-{uuid.uuid4().hex}"
    messy.write.option("header", True).option("ignoreLeadingWhiteSpace", False).option(
        "ignoreTrailingWhiteSpace", False
    ).csv(path)
    return read_decoded(spark, path)


def _normalized_occupancy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _occupancy(spark, sf_dir).select(
        "subject_id", "state",
        normalize_probability(F.col("n_state").cast("double"), ["subject_id"], 0.5)
        .alias("probability"),
    )


Query = Callable[[SparkSession, str], DataFrame]


def sequence_queries() -> dict[str, Query]:
    return {
        "decoded_sequences": lambda s, d: views.decoded_events(s, d),
        "standardize_groups": _mixed_labels,
        "subject_checks": lambda s, d: validate.subject_checks(_faulty(s, d)),
        "row_violations": lambda s, d: validate.row_violations(
            decoded(s, d), K - 1, (config.REFERENCE_GROUP, config.TARGET_GROUP)
        ),
        "subject_information": lambda s, d: _subjects(s, d),
        "subject_occupancy": lambda s, d: occupancy.subject_occupancy(decoded(s, d), K),
        "occupancy_wide": lambda s, d: occupancy.occupancy_wide(_occupancy(s, d), K),
        "group_occupancy_summary": lambda s, d: occupancy.group_occupancy_summary(
            _occupancy(s, d)
        ),
        "occupancy_bars": lambda s, d: occupancy.occupancy_bars(
            occupancy.group_occupancy_summary(_occupancy(s, d))
        ),
        "normalized_occupancy": _normalized_occupancy,
        "decoded_from_csv": _decoded_from_csv,
        "occupancy_permutation_test": lambda s, d: occupancy.occupancy_permutation_test(
            _occupancy(s, d), K
        ),
        "state_runs": lambda s, d: runs.state_runs(decoded(s, d)),
        "complete_sojourn_runs": lambda s, d: runs.complete_runs(runs.state_runs(decoded(s, d))),
        "sojourn_group_summary": lambda s, d: sojourn.sojourn_group_summary(
            _complete(s, d), _subjects(s, d), K
        ),
        "duration_distribution": lambda s, d: sojourn.duration_distribution(_complete(s, d)),
        "observed_kl": lambda s, d: sojourn.observed_kl(_complete(s, d), K),
        "kl_permutation_test": lambda s, d: sojourn.kl_permutation_test(
            _complete(s, d), _subjects(s, d), K
        ),
        "subject_transitions": lambda s, d: transitions.subject_transition_table(
            _counts(s, d), K
        ),
        "transition_count_matrices": lambda s, d: transitions.wide_matrices(_counts(s, d), K, "transition_count"),
        "transition_probability_matrices": lambda s, d: transitions.wide_matrices(_counts(s, d), K, "probability"),
        "transition_difference_matrix": lambda s, d: transitions.difference_matrix(_counts(s, d), K),
        "length_check": lambda s, d: validate.length_check(_subjects(s, d), decoded(s, d)),
        "occupancy_violations": lambda s, d: occupancy.occupancy_totals(_occupancy(s, d)),
        "group_transition_matrices": lambda s, d: transitions.group_transition_matrices(
            _counts(s, d), K
        ),
        "transition_permutation_test": lambda s, d: transitions.transition_permutation_test(
            _counts(s, d), K
        ),
        "large_transition_differences": lambda s, d: transitions.large_differences(
            transitions.transition_permutation_test(_counts(s, d), K)
        ),
        "transition_differences_from_half_percent": lambda s, d: transitions.large_differences(
            transitions.transition_permutation_test(_counts(s, d), K), 0.005
        ),
        "ordered_transition_comparison": lambda s, d: transitions.transition_comparison(
            transitions.transition_permutation_test(_counts(s, d), K),
            transitions.transition_bootstrap(_counts(s, d), K),
        ),
        "transition_bootstrap_ci": lambda s, d: transitions.transition_bootstrap(
            _counts(s, d), K
        ),
        "wide_state_sequences": lambda s, d: occupancy.wide_state_sequences(
            decoded(s, d), SEQUENCE_WIDTH
        ),
        "labeling_agreement": _labeling_agreement,
    }


def _moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hub(
        spark, sf_dir, "state_moments",
        lambda: matrices.state_moments(views.state_observations(spark, sf_dir)),
    )


def _correlation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hub(
        spark, sf_dir, "state_correlation",
        lambda: matrices.covariance_to_correlation(_moments(spark, sf_dir)),
    )


def _edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.positive_edges(_correlation(spark, sf_dir))


def _nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.nodes_of(_correlation(spark, sf_dir))


def _members(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hub(
        spark, sf_dir, "louvain_memberships",
        lambda: graph.louvain_memberships(_edges(spark, sf_dir), _nodes(spark, sf_dir)),
    )


def _given_memberships(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight partitions of every network by a formula."""
    rep = F.explode(F.sequence(F.lit(1), F.lit(8)))
    nodes = _nodes(spark, sf_dir).select("state", "node", rep.alias("rep"))
    return nodes.withColumn("community", ((F.col("node") * F.col("rep") + F.col("state")) % 5).cast("int"))


def _topology(spark: SparkSession, sf_dir: str, which: int) -> DataFrame:
    return graph.topology_tables(_correlation(spark, sf_dir), agreements=_agreement(spark, sf_dir))[which]


def _agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hub(
        spark, sf_dir, "louvain_agreement", lambda: graph.agreement(_members(spark, sf_dir))
    )


def _matrices_from_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """State correlation matrices written as CSV and read back."""
    folder = f"{shared_dir(spark)}/matrices-{uuid.uuid4().hex}"
    Output(spark, folder).matrices(
        _correlation(spark, sf_dir), "r", "correlation_matrix", ROI_NAMES
    )
    matrix, source = state_correlations(spark, folder, views.EMBEDDING_K)
    return matrix.withColumn("matrix_source", F.lit(source))


def _zscored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matrices.zscore_by_subject(
        views.observed_series(spark, sf_dir), [f"x{i}" for i in range(1, 5)]
    )


ROI_NAMES = [f"ROI_{i:02d}" for i in range(1, views.EMBEDDING_P + 1)]


def matrix_queries() -> dict[str, Query]:
    return {
        "observed_series": views.observed_series,
        "zscore_series": _zscored,
        "variance_violations": lambda s, d: matrices.variance_violations(
            views.observed_series(s, d).withColumn(
                "x4", F.when(F.col("subject_id") % 3 == 0, F.lit(1.0)).otherwise(F.col("x4"))
            ),
            ["x1", "x2", "x3", "x4"],
        ),
        "state_covariance": lambda s, d: matrices.state_moments(
            views.state_observations(s, d)
        ).select("state", "i", "j", "n", "cov"),
        "state_correlation": lambda s, d: matrices.covariance_to_correlation(_moments(s, d)),
        "state_correlation_wide": lambda s, d: matrices.matrix_wide(
            _correlation(s, d), "r", views.EMBEDDING_P
        ),
        "state_summary": lambda s, d: matrices.state_summary(
            _correlation(s, d), matrices.state_means(_moments(s, d))
        ),
        "mean_signal_long": lambda s, d: matrices.roi_names(
            matrices.state_means(_moments(s, d)), ROI_NAMES
        ).select("state", "roi", "mean_signal"),
        "mean_signal_wide": lambda s, d: matrices.roi_names(
            matrices.mean_signal_wide(
                matrices.state_means(_moments(s, d)), views.EMBEDDING_K
            ), ROI_NAMES
        ).drop("i"),
        "state_similarity": lambda s, d: matrices.state_similarity(
            _moments(s, d), matrices.state_means(_moments(s, d))
        ),
        "positive_edges": _edges,
        "node_degrees": lambda s, d: graph.node_degrees(_edges(s, d), _nodes(s, d)),
        "network_summary": lambda s, d: graph.network_summary(
            graph.node_degrees(_edges(s, d), _nodes(s, d))
        ),
        "density_threshold_edges": lambda s, d: graph.density_edges(_edges(s, d), _nodes(s, d)),
        "density_threshold_summary": lambda s, d: graph.density_summary(
            graph.density_edges(_edges(s, d), _nodes(s, d)), _edges(s, d)
        ),
        "edge_widths": lambda s, d: graph.edge_widths(
            graph.density_edges(_edges(s, d), _nodes(s, d))
        ).select("percent", "state", "i", "j", "width"),
        "shortest_paths": lambda s, d: graph.shortest_paths(_edges(s, d)),
        "path_metrics": lambda s, d: graph.path_metrics(
            graph.shortest_paths(_edges(s, d)), _nodes(s, d)
        ),
        "local_efficiency": lambda s, d: graph.local_efficiency(_edges(s, d), _nodes(s, d)),
        "weighted_clustering": lambda s, d: graph.weighted_clustering(
            _edges(s, d), _nodes(s, d)
        ).select("state", "node", "weighted_clustering"),
        "node_betweenness": lambda s, d: graph.node_betweenness(_edges(s, d), _nodes(s, d)),
        "given_partition_agreement": lambda s, d: graph.agreement(_given_memberships(s, d)),
        "given_partition_modularity": lambda s, d: graph.partition_modularity(
            _edges(s, d), _given_memberships(s, d).filter("rep = 3")
        ),
        "topology_primary_metrics": lambda s, d: _topology(s, d, 0),
        "topology_additional_metrics": lambda s, d: _topology(s, d, 1),
        "topology_node_metrics": lambda s, d: _topology(s, d, 2),
        "state_matrices_from_csv": _matrices_from_csv,
        "louvain_memberships": _members,
        "consensus_agreement": _agreement,
        "consensus_communities": lambda s, d: graph.consensus_communities(
            _agreement(s, d), _nodes(s, d)
        ),
    }


CRITERIA_SIGNALS = 20
VIEW_SIGNALS = 16
# The model queries fit with config's settings (K, starts, durations, iterations, tolerance) and choose
# among converged fits only. Settings of hsmm_em10_fits, a check of a fixed number of EM iterations
# from which nothing is chosen:
HSMM_K = (2, 3)
HSMM_STARTS = (1, 2)
HSMM_DURATION_CAP = 20
HSMM_ITERATIONS = 10
HSMM_SIGNALS = ("z1", "z2", "z3", "z4")

_chunks: dict[tuple, Chunks] = {}


def _chunk_table(spark: SparkSession, sf_dir: str) -> Chunks:
    key = (spark.sparkContext.applicationId, sf_dir, fingerprint(spark, sf_dir))
    if key not in _chunks:
        lengths = (
            views.table(spark, sf_dir, "lineitem")
            .groupBy(F.col("l_suppkey").alias("subject_id"))
            .agg(F.count(F.lit(1)).alias("n_timepoints"))
        )
        _chunks[key] = chunk_table(_zscored(spark, sf_dir), HSMM_SIGNALS, lengths=lengths)
    return _chunks[key]


def _em10_fits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two starts of two K after HSMM_ITERATIONS iterations (fewer if converged)."""

    def build() -> DataFrame:
        chunks = _chunk_table(spark, sf_dir)
        fits = fit_starts(
            chunks, planned_starts(HSMM_K, HSMM_STARTS), HSMM_DURATION_CAP, HSMM_ITERATIONS
        )
        return fit_table(spark, fits, HSMM_ITERATIONS)

    return hub(spark, sf_dir, "hsmm_em10_fits", build)


def _fitted(spark: SparkSession, sf_dir: str, k_values, starts) -> DataFrame:
    """Fits with config's settings, each run until it converges or reaches the iteration limit. Their journal
    is named by the data and the starts, so a job that was stopped goes on where it was."""
    planned = planned_starts(k_values, starts)
    text = repr((sf_dir, fingerprint(spark, sf_dir), HSMM_SIGNALS, planned, config.DURATION_CAP))
    journal = Journal(spark, f"{shared_dir(spark)}/fits-{hashlib.sha256(text.encode()).hexdigest()[:24]}")
    return fit_table(spark, fit_starts(_chunk_table(spark, sf_dir), planned, journal=journal))


def _fits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All starts of all candidate K."""
    starts = range(1, config.STARTS_MODEL_SELECTION + 1)
    return hub(spark, sf_dir, "hsmm_fits", lambda: _fitted(spark, sf_dir, config.K_VALUES, starts))


def _selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks, fits = _chunk_table(spark, sf_dir), _fits(spark, sf_dir)
    select.require_all_k(fits)
    return select.model_selection(
        fits, chunks.p, min(config.DURATION_CAP, chunks.longest), chunks.n_rows
    )


def _selected_fits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fits of the selected K, with the starts that only this K gets."""

    def build() -> DataFrame:
        k = select.selected_k(_selection(spark, sf_dir))
        more = range(config.STARTS_MODEL_SELECTION + 1, config.STARTS_SELECTED_K + 1)
        kept = _fits(spark, sf_dir).filter(F.col("k") == k)
        return kept.unionByName(_fitted(spark, sf_dir, [k], more))

    return hub(spark, sf_dir, "hsmm_selected_fits", build)


def _selected_runs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, dict, int]:
    """Converged fits of the selected K numbered as runs, their models and K."""
    kept = select.usable(_selected_fits(spark, sf_dir)).withColumn(
        "run", F.row_number().over(Window.partitionBy("k").orderBy("start"))
    )
    rows = kept.collect()
    if len(rows) < 2:
        raise ValueError("stability needs two converged starts of the chosen K")
    return kept, {r["run"]: model_of(r) for r in rows}, int(rows[0]["k"])


def _final(spark: SparkSession, sf_dir: str) -> DataFrame:
    return select.best_fits(_selected_fits(spark, sf_dir))


def _final_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = _chunk_table(spark, sf_dir)
    final = _final(spark, sf_dir).select(
        "k", F.col("start").alias("final_start"), F.col("seed").alias("final_seed"),
        F.col("log_lik").alias("final_log_lik"),
    )
    return select.with_criteria(
        final, "final_log_lik", chunks.p, min(config.DURATION_CAP, chunks.longest), chunks.n_rows
    )


def _viterbi(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = model_of(_final(spark, sf_dir).first())
    return decoded_rows(_chunk_table(spark, sf_dir), {0: model}).drop("model_id")


def _hsmm_parameters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long parameter table of the final model."""
    final = _final(spark, sf_dir)
    init = final.select(F.lit("init").alias("part"), F.posexplode("model.init").alias("i", "value"))
    parts = [init.select("part", (F.col("i") + 1).alias("i"), F.lit(None).cast("int").alias("j"), "value")]
    for name in ("transition", "duration", "mu"):
        rows = final.select(F.posexplode(f"model.{name}").alias("i", "row"))
        cells = rows.select("i", F.posexplode("row").alias("j", "value"))
        parts.append(
            cells.select(F.lit(name).alias("part"), (F.col("i") + 1).alias("i"),
                         (F.col("j") + 1).alias("j"), "value")
        )
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def _hsmm_stability(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept, models, k = _selected_runs(spark, sf_dir)
    sigma, mu = match.parameter_tables(kept)
    labelled = materialize(
        decoded_labels(_chunk_table(spark, sf_dir), models), "decoded_by_run"
    )
    return match.with_starts(match.pairwise_stability(sigma, mu, labelled, sorted(models), k), kept)


def _hsmm_within(spark: SparkSession, sf_dir: str) -> DataFrame:
    sigma, mu = match.parameter_tables(_final(spark, sf_dir).withColumn("run", F.lit(1)))
    return matrices.state_similarity(
        sigma.withColumnRenamed("v", "cov"), mu.withColumnRenamed("v", "mean_signal")
    )


def _criteria(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Criteria over K = 2..10 for histogram likelihoods of l_quantity with K equal bins."""
    binned = views.table(spark, sf_dir, "lineitem").select(
        F.explode(F.sequence(F.lit(2), F.lit(10))).alias("k"), "l_quantity"
    ).select("k", F.least(F.col("k") - 1, F.floor((F.col("l_quantity") - 1) * F.col("k") / 50)).alias("bin"))
    counts = binned.groupBy("k", "bin").agg(F.count(F.lit(1)).cast("double").alias("n"))
    fits = counts.groupBy("k").agg(
        (F.sum(F.col("n") * F.log("n")) - F.sum("n") * F.log(F.sum("n"))).alias("log_lik"),
        F.sum("n").alias("n_total"),
    )
    scored = select.with_criteria(fits, "log_lik", CRITERIA_SIGNALS, config.DURATION_CAP, F.col("n_total"))
    return select.with_bic_rank(scored).drop("n_total")


def _view_tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """State covariances and means of four windows of 16 signals, together the whole embedding,
    as four runs."""
    sigma = mu = None
    for run, first in enumerate(range(1, views.EMBEDDING_P, VIEW_SIGNALS), 1):
        moments = hub(
            spark, sf_dir, f"view_moments_{run}",
            lambda first=first: matrices.state_moments(
                views.state_observations(spark, sf_dir, first, VIEW_SIGNALS)
            ),
        ).withColumn("run", F.lit(run))
        s = moments.filter("i < j").select("run", "state", "i", "j", F.col("cov").alias("v"))
        m = moments.filter("i = j").select("run", "state", "i", F.col("mean_i").alias("v"))
        sigma = s if sigma is None else sigma.unionByName(s)
        mu = m if mu is None else mu.unionByName(m)
    return sigma, mu


def _similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hub(
        spark, sf_dir, "view_similarity",
        lambda: match.run_similarity(*_view_tables(spark, sf_dir)),
    )


def _matched(spark: SparkSession, sf_dir: str) -> DataFrame:
    similarity = _similarity(spark, sf_dir)
    return match.matched_correlations(similarity, match.matched_states(similarity))


def _labelings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three labelings of every event: type, value band, part of the day."""
    value = F.least(F.lit(5), F.greatest(F.lit(1), 1 + F.floor(F.col("value") / 20))).cast("int")
    part = (1 + F.floor(F.hour("ts") / 5)).cast("int")
    return views.table(spark, sf_dir, "events").select(
        F.col("user_id").alias("subject_id"),
        F.array(views.event_state(F.col("event_type")), value, part).alias("labels"),
    )


def _labeling_occupancy(spark: SparkSession, sf_dir: str) -> DataFrame:
    products = match.occupancy_products(match.labels_long(_labelings(spark, sf_dir), [1, 2, 3]), K)
    same = products.select(*match.PAIR, "state_a", "state_b").filter("state_a = state_b")
    return match.occupancy_correlation(products, same)


def model_queries() -> dict[str, Query]:
    names = ("covariance_correlation", "mean_vector_correlation")
    metrics = [f"{n}_{s}" for n in names for s in ("median", "minimum")]
    return {
        "information_criteria": _criteria,
        "run_similarity": _similarity,
        "matched_states": lambda s, d: match.matched_states(_similarity(s, d)),
        "matched_correlations": _matched,
        "stability_metric_summary": lambda s, d: match.stability_summary(_matched(s, d), metrics),
        "pair_agreement": lambda s, d: match.pair_agreement(_labelings(s, d), [1, 2, 3]),
        "occupancy_correlation": _labeling_occupancy,
        "given_model_statistics": lambda s, d: given_model.statistics(_chunk_table(s, d)),
        "given_model_next": lambda s, d: given_model.next_model(_chunk_table(s, d)),
        "given_model_paths": lambda s, d: given_model.best_paths(_chunk_table(s, d)),
        "given_model_lloyd_step": lambda s, d: given_model.lloyd_step(_chunk_table(s, d)),
        "given_model_shrinkage": lambda s, d: given_model.shrunk_covariances(_chunk_table(s, d)),
        "hsmm_em10_fits": lambda s, d: _em10_fits(s, d).drop("model", "log_lik_trace"),
        "hsmm_fits": lambda s, d: _fits(s, d).drop("model", "log_lik_trace"),
        "hsmm_model_selection": _selection,
        "hsmm_final_summary": _final_summary,
        "hsmm_parameters": _hsmm_parameters,
        "viterbi_decode": _viterbi,
        "hsmm_pairwise_stability": _hsmm_stability,
        "hsmm_state_similarity": _hsmm_within,
    }


def all_queries() -> dict[str, Query]:
    def rounded(query: Query) -> Query:
        return lambda spark, sf_dir: presentable(query(spark, sf_dir))

    queries = {**sequence_queries(), **matrix_queries(), **model_queries()}
    return {name: rounded(q) for name, q in queries.items()}
