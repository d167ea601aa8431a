"""Whole plans from counts to calls: enriched features against input and control, and variant sites to their motif."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagtally.operators import counts as C
from tagtally.operators import sequences as Q
from tagtally.operators import statistics as S
from tagtally.operators import variants as V
from tagtally.session import shared_folder

#: Pairs of conditions by the suffix of their columns.
PAIRS = {"pI": ("IP", "Input"), "cI": ("Control", "Input")}


def prepared(counts: DataFrame, normaliser: Column, least: int = 2) -> tuple[DataFrame, DataFrame]:
    """Counts of expressed features without the normalising ones, and size factors from these."""
    kept = counts.join(C.expressed(counts, least), "feature", "left_semi")
    factors = C.size_factors(kept, normaliser)
    return kept.where(~normaliser), factors


def moment_contrasts(counts: DataFrame, factors: DataFrame) -> DataFrame:
    """The contrasts of ``PAIRS`` by moments of log counts, with two-sided normal p and BH: what ``nb_contrasts`` returns, where no model is wanted."""
    from tagtally.functions.tail_columns import normal_sf

    rows = C.log_normalised(counts, factors)
    parts = []
    for name, (test, base) in PAIRS.items():
        one = C.contrast(rows, test, base, "x").withColumn("stat", C.ratio(F.col("lfc_x"), F.col("se_x")))
        parts.append(one.select(F.lit(name).alias("contrast"), "feature", F.col("lfc_x").alias("log2FoldChange"), F.col("se_x").alias("lfcSE"), "stat", (2 * normal_sf(F.abs("stat"))).alias("pvalue")))
    return C.benjamini_hochberg(parts[0].unionByName(parts[1]), "pvalue", "padj", "contrast")


def called(fits: DataFrame, factors: DataFrame, least: float = 0.5, alpha: float = 0.05) -> DataFrame:
    """Features with both contrasts, the difference between them, its tail over the empirical null, and flags.

    ``fits`` are rows of ``contrast`` pI and cI; ``factors`` ``replicate, condition, size_factor``, whose replicates' median
    offset corrects the difference. Features of one contrast stay, with NULLs.
    """
    columns = [c for c in ("log2FoldChange", "lfcSE", "stat", "pvalue", "padj") if c in fits.columns]
    short = {"log2FoldChange": "lfc", "lfcSE": "se"}
    side = lambda n: fits.where(F.col("contrast") == n).select("feature", *[F.col(c).alias(f"{short.get(c, c)}_{n}") for c in columns])
    offset = C.replicate_offsets(factors).first()["offset"]
    rows = C.delta_wald(side("pI"), side("cI"), float(offset) if offset is not None else 0.0)
    shared_folder(fits.sparkSession)
    rows = rows.checkpoint()  # read twice: for the null's spread and for its tails
    sd = float(C.null_sd(rows).first()["sd"])
    return C.call_flags(C.with_wald_p(rows, sd), least=least, alpha=alpha).withColumn("null_sd", F.lit(sd))


def true_positives(counts: DataFrame, normaliser: Column, least: float = 0.5, alpha: float = 0.05, model: str = "nb") -> DataFrame:
    """From ``feature, sample, replicate, condition, count`` to calls: filter, size factors, both contrasts in one pass, offset, null, BH, flags.

    ``model`` is ``nb`` for negative-binomial fits or ``moments``. A library whose normalising features have no count
    cannot be scaled: that is an error.
    """
    kept, factors = prepared(counts, normaliser)
    shared_folder(counts.sparkSession)
    factors = factors.checkpoint()  # a row for each library
    if factors.where("size_factor is null or size_factor <= 0").count():
        raise ValueError("a library has no counts of the normalising features")
    fits = S.nb_contrasts(kept, factors, PAIRS) if model == "nb" else moment_contrasts(kept, factors)
    libraries = counts.select("sample", "replicate", "condition").distinct().join(factors, "sample")
    return called(fits, libraries, least, alpha)


def variant_sites(sums: DataFrame, least_depth: int = 1, least_pairs: int = 3, effect: float = math.log(1.25), alpha: float = 0.05, test: str = "moderated") -> DataFrame:
    """From pooled counts ``site, pair, condition, K, N`` to tested sites with ``hit``: paired logits, weighted fits, t (or normal) p, BH."""
    from tagtally.functions.tail_columns import normal_sf

    fit = V.weighted_fit(V.paired_logits(V.paired(sums, least_depth)), least_pairs)
    if test == "moderated":
        rows = V.moderated(fit)
    else:
        rows = fit.withColumn("t", F.col("beta") * F.sqrt("sw")).withColumn("p", 2 * normal_sf(F.abs("t")))
        rows = C.benjamini_hochberg(rows, "p", "padj")
    return rows.withColumn("hit", F.coalesce((F.col("beta") > effect) & (F.col("padj") < alpha), F.lit(False)))


def motif_sites(sites: DataFrame, places: DataFrame, fasta: DataFrame, k: int = 7, stratum: str | None = None) -> dict[str, DataFrame]:
    """Tested sites in their sequences: ``sites`` with context, log-odds of the hits' bases by position, and the GC permutation null.

    ``places`` are ``site, transcript_id, pos`` (and the stratum); sites whose k-mer is not of the four bases take no part in the motif.
    """
    flank = k // 2
    rows = sites.join(places, "site")
    rows = Q.with_context(rows, fasta, flank)
    shared_folder(sites.sparkSession)
    rows = rows.checkpoint()  # read by both statistics
    words = Q.kmers(rows.where("sequence_context is not null"), k, "sequence_context")
    by = [stratum] if stratum else []
    words = words.select("site", "hit", "kmer", *by)
    if not stratum:
        words, stratum = words.withColumn("all", F.lit("all")), "all"
    return {"sites": rows, "log_odds": Q.log_odds(words.where("hit"), words.where("not hit")), "permutation": Q.permutation_gc(words, stratum)}
