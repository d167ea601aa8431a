"""Column sets of the tables the operators take, and the check that they are there."""

from __future__ import annotations

from pyspark.sql import DataFrame

ALIGNMENTS = "qname string, flag int, rname string, pos int, mapq int, cigar string, rnext string, pnext int, tlen int, seq string, qual string, as int, nm int, rx string, tags string, ord long"
CANDIDATES = "qname string, umi string, seq string, rname string, as int, nm int"
COUNTS = "transcript string, count double"
PILEUP = "chr string, pos int, ref_base string, packed string"
METADATA = "sample_name string, group_name string, replicates string, plot_name string"
FASTA = "id string, seq string"
FASTQ = "qname string, seq string, qual string"


class MissingColumns(ValueError):
    """A table lacks columns that an operator needs."""


def require_columns(df: DataFrame, *names: str) -> DataFrame:
    """``df`` itself, if it has all the named columns."""
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise MissingColumns(f"missing columns: {', '.join(missing)}; found: {', '.join(df.columns)}")
    return df
