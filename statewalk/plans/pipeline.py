"""The analysis from observations to result tables, stage by stage.

Every stage starts from tables the stage before has written, so a lost executor or a rerun of one
stage never goes back to the workbooks.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from statewalk import config
from statewalk.model import match, select
from statewalk.model.chunks import chunk_table
from statewalk.model.decode import decoded_labels, decoded_rows
from statewalk.model.fit import fit_starts, fit_table, model_of, start_log
from statewalk.model.journal import Journal
from statewalk.model.start import planned_starts
from statewalk.operators import graph, matrices, occupancy, runs, sojourn, transitions, validate
from statewalk.sinks.tables import Output
from statewalk.sources.tables import model_covariances, model_means, read_models, state_correlations


@dataclass
class Settings:
    k_values: Sequence[int] = config.K_VALUES
    starts_model_selection: int = config.STARTS_MODEL_SELECTION
    starts_selected_k: int = config.STARTS_SELECTED_K
    max_iterations: int = config.MAX_ITERATIONS
    tolerance: float = 1e-4
    kmeans_iterations: int = 100
    duration_cap: int = config.DURATION_CAP
    master_seed: int = config.MASTER_SEED
    occupancy_permutations: int = config.OCCUPANCY_PERMUTATIONS
    sojourn_permutations: int = config.SOJOURN_PERMUTATIONS
    transition_permutations: int = config.TRANSITION_PERMUTATIONS
    bootstraps: int = config.BOOTSTRAPS
    louvain_repetitions: int = config.LOUVAIN_REPETITIONS
    edge_proportions: Sequence[float] = field(default=config.EDGE_PROPORTIONS)
    sequence_width: int = config.DURATION_CAP


def model_stage(
    spark: SparkSession, observations: DataFrame, signals: Sequence[str], out: Output, s: Settings
) -> int:
    """Standardise, fit all starts, choose K by BIC, refit the chosen K with more starts, decode
    with the best fit and measure the stability of the starts. Returns the chosen K."""
    observations = out.table(observations, "observations")
    subjects = out.table(validate.subject_information(observations), "subject_information")
    scaled = matrices.zscore_by_subject(observations, list(signals))
    columns = ["z" + c.lstrip("x") for c in signals]
    chunks = chunk_table(scaled, columns, lengths=subjects.select("subject_id", "n_timepoints"))
    m = min(s.duration_cap, chunks.longest)

    def fit(k_values: Sequence[int], starts: Sequence[int]) -> DataFrame:
        fits = fit_starts(
            chunks, planned_starts(k_values, starts, s.master_seed), s.duration_cap,
            s.max_iterations, s.tolerance, s.kmeans_iterations,
            Journal(spark, out.path(f"fit_journal_{min(k_values)}_{max(k_values)}_{min(starts)}")),
        )
        return fit_table(spark, fits, s.max_iterations)

    first = range(1, s.starts_model_selection + 1)
    fits = out.table(fit(s.k_values, first), "fits_model_selection", ["k"])
    out.report(fits.drop("model", "log_lik_trace"), "random_starts_model_selection")
    out.table(start_log(fits), "log_likelihood_by_iteration")
    select.require_all_k(fits)
    selection = out.report(
        select.model_selection(fits, chunks.p, m, chunks.n_rows), "model_selection_bic"
    )
    k = select.selected_k(selection)

    kept = fits.filter(F.col("k") == k)
    if s.starts_selected_k > s.starts_model_selection:
        more = range(s.starts_model_selection + 1, s.starts_selected_k + 1)
        kept = kept.unionByName(fit([k], more))
    kept = out.table(kept, "fits_selected_k")
    out.report(kept.drop("model", "log_lik_trace"), "random_starts_selected_k")
    eligible = select.usable(kept).orderBy("start").collect()
    if len(eligible) < 2:
        raise ValueError("stability needs two converged starts of the chosen K")
    final = out.table(select.best_fits(kept), "final_model")
    out.report(
        select.with_criteria(
            final.select(
                F.col("k").alias("k"), F.lit(kept.count()).alias("attempted_starts"),
                F.lit(len(eligible)).alias("eligible_starts"), F.col("start").alias("final_start"),
                F.col("seed").alias("final_seed"), F.col("log_lik").alias("final_log_lik"),
            ),
            "final_log_lik", chunks.p, m, chunks.n_rows,
        ),
        "final_model_summary",
    )
    out.table(
        decoded_rows(chunks, {0: model_of(final.first())}).drop("model_id"), "decoded_states"
    )

    models = {i: model_of(r) for i, r in enumerate(eligible, 1)}
    run_of = F.create_map(*[F.lit(v) for i, r in enumerate(eligible, 1) for v in (r["start"], i)])
    numbered = select.usable(kept).withColumn("run", F.element_at(run_of, F.col("start")))
    sigma, mu = match.parameter_tables(numbered)
    by_run = out.table(decoded_labels(chunks, models), "decoded_by_run")
    pairs = out.report(
        match.with_starts(match.pairwise_stability(sigma, mu, by_run, sorted(models), k), numbered), "pairwise_stability"
    )
    out.report(match.stability_summary(pairs), "stability_summary")
    out.report(
        matrices.state_similarity(model_covariances(final), model_means(final)),
        "within_model_state_similarity",
    )
    out.settings(
        {**asdict(s), "variables": chunks.p, "observations": chunks.n_rows, "M": m,
         "selected_K": k},
        "analysis_settings",
    )
    out.versions()
    return k


def state_stage(
    spark: SparkSession, final: DataFrame, k: int, names: Sequence[str], out: Output
) -> None:
    """Covariance and correlation matrices, summaries and mean signals of the final model."""
    cov = out.table(model_covariances(final), "state_covariance")
    corr = out.table(matrices.covariance_to_correlation(cov), "state_correlation")
    means = model_means(final)
    out.matrices(cov, "cov", "covariance_matrix", names)
    out.matrices(corr, "r", "correlation_matrix", names)
    out.report(matrices.state_summary(corr, means), "state_correlation_and_mean_signal_summary", 6)
    out.report(matrices.roi_names(means, names), "state_mean_signal_long")
    out.report(
        matrices.roi_names(matrices.mean_signal_wide(means, k), names), "state_mean_signal_wide"
    )
    out.settings({"selected_K": k, "variables": len(names)}, "state_settings")


def occupancy_stage(
    spark: SparkSession, decoded: DataFrame, k: int, out: Output, s: Settings
) -> None:
    validate.check_decoded(decoded, k)
    subjects = out.table(validate.subject_information(decoded), "decoded_subject_information")
    validate.check_lengths(subjects, decoded)
    long = out.table(occupancy.subject_occupancy(decoded, k), "subject_occupancy_long")
    occupancy.check_occupancy(long)
    out.table(occupancy.occupancy_wide(long, k), "subject_occupancy")
    out.table(
        occupancy.wide_state_sequences(decoded, s.sequence_width), "viterbi_sequences_wide"
    )
    summary = out.report(
        occupancy.group_occupancy_summary(long), "group_occupancy_summary", 4
    )
    out.report(occupancy.occupancy_bars(summary), "occupancy_bars")
    out.report(
        occupancy.occupancy_permutation_test(long, k, s.occupancy_permutations),
        "state_occupancy_permutation_tests", 6,
    )
    out.settings({"selected_K": k, **asdict(s)}, "occupancy_settings")


def sojourn_stage(
    spark: SparkSession, decoded: DataFrame, k: int, out: Output, s: Settings
) -> None:
    validate.check_decoded(decoded, k)
    if s.duration_cap < 1:
        raise ValueError("the largest duration must be 1 or more")
    complete = out.table(runs.complete_runs(runs.state_runs(decoded)), "complete_sojourn_runs")
    if complete.isEmpty():
        raise ValueError("no complete internal runs")
    subjects = validate.subject_information(decoded)
    out.report(sojourn.sojourn_group_summary(complete, subjects, k), "sojourn_group_summary")
    out.report(
        sojourn.duration_distribution(complete, cap=s.duration_cap), "sojourn_distributions"
    )
    out.report(
        sojourn.kl_permutation_test(
            complete, subjects, k, s.sojourn_permutations, cap=s.duration_cap
        ),
        "sojourn_kl_permutation_results", 6,
    )
    out.settings({"selected_K": k, **asdict(s)}, "sojourn_settings")


def transition_stage(
    spark: SparkSession, decoded: DataFrame, k: int, out: Output, s: Settings
) -> None:
    validate.check_decoded(decoded, k)
    counts = out.table(transitions.subject_counts(decoded, k), "subject_transition_counts")
    out.table(transitions.subject_transition_table(counts, k), "subject_transition_table")
    out.report(transitions.group_transition_matrices(counts, k), "group_transition_matrices")
    for value, name in (("transition_count", "count"), ("probability", "probability")):
        wide = transitions.wide_matrices(counts, k, value)
        for group, label in ((config.REFERENCE_GROUP, "td"), (config.TARGET_GROUP, "dyslexia")):
            own = wide.filter(F.col("group") == group).drop("group")
            out.report(own.orderBy("from_state"), f"transition_{name}_matrix_{label}")
    difference = transitions.difference_matrix(counts, k)
    out.report(difference.orderBy("from_state"), "transition_probability_difference_matrix")
    tested = transitions.transition_permutation_test(counts, k, s.transition_permutations)
    intervals = transitions.transition_bootstrap(counts, k, s.bootstraps)
    full = out.report(
        transitions.transition_comparison(tested, intervals), "transition_group_comparison", 6
    )
    out.report(transitions.large_differences(full), "large_transition_differences")
    out.settings({"selected_K": k, **asdict(s)}, "transition_settings")


def topology_stage(
    spark: SparkSession,
    state_folder: str,
    k: int,
    out: Output,
    s: Settings,
    fallback: DataFrame | None = None,
) -> None:
    matrix, source = state_correlations(spark, state_folder, k, fallback)
    matrix = out.table(matrix, "network_matrices")
    nodes, edges = graph.nodes_of(matrix), graph.positive_edges(matrix)
    members = out.table(
        graph.louvain_memberships(edges, nodes, s.louvain_repetitions), "louvain_memberships"
    )
    agreed = out.table(graph.agreement(members), "consensus_agreement_raw")
    out.table(graph.thresholded_agreement(agreed), "consensus_agreement")
    primary, additional, node_table = graph.topology_tables(matrix, agreements=agreed)
    out.report(primary, "state_topology_primary_metrics", 6)
    out.report(additional, "state_topology_additional_metrics", 6)
    out.report(node_table, "state_topology_node_metrics", 6)
    kept = out.table(
        graph.edge_widths(graph.density_edges(edges, nodes, s.edge_proportions)),
        "thresholded_edges", ["percent"],
    )
    out.report(graph.density_summary(kept, edges), "threshold_summary")
    out.settings({"matrix_source": source, **asdict(s)}, "topology_settings")


def run_pipeline(
    spark: SparkSession,
    observations: DataFrame,
    signals: Sequence[str],
    names: Sequence[str],
    folder: str,
    settings: Settings | None = None,
) -> int:
    """All stages. The model stage refuses to overwrite an earlier analysis."""
    s = settings or Settings()
    out = Output(spark, folder, fresh=True)
    k = model_stage(spark, observations, signals, out, s)
    later = Output(spark, folder)
    final = read_models(spark, out.path("final_model"), k)
    state_stage(spark, final, k, names, later)
    decoded = spark.read.parquet(out.path("decoded_states"))
    occupancy_stage(spark, decoded, k, later, s)
    sojourn_stage(spark, decoded, k, later, s)
    transition_stage(spark, decoded, k, later, s)
    topology_stage(spark, folder, k, later, s, model_covariances(final))
    return k


def load_analysis(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """Tables of a finished analysis as temporary views for interactive use; nothing is refitted."""
    final = read_models(spark, f"{folder}/final_model")
    decoded = spark.read.parquet(f"{folder}/decoded_states")
    tables = {
        "final_model": final, "decoded_states": decoded,
        "subject_information": validate.subject_information(decoded),
        "state_means": model_means(final), "state_covariances": model_covariances(final),
        "initial_probabilities": final.select(F.posexplode("model.init").alias("pos", "probability"))
        .select((F.col("pos") + 1).alias("state"), "probability"),
    }
    for name, df in tables.items():
        df.createOrReplaceTempView(name)
    return tables
