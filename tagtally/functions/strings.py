"""String expressions of the domain: tags in names, conditions, keys, families, sequences."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def umi_of(qname: Column, delimiter: str = "_") -> Column:
    """Last field of a name; NULL without the delimiter or with nothing after it."""
    field = F.trim(F.substring_index(qname, delimiter, -1))
    return F.when(F.instr(qname, delimiter) > 0, F.when(F.length(field) > 0, field))


def umi_or_tag(qname: Column, tag: Column | None, source: str = "qname", delimiter: str = "_", length: int | None = None) -> Column:
    """The molecular tag: from the tag column (falling back to the name) or from the name, of a fixed length if asked for."""
    value = umi_of(qname, delimiter)
    if source.upper() == "RX" and tag is not None:
        value = F.coalesce(F.when(F.length(F.trim(tag)) > 0, F.trim(tag)), value)
    return value if length is None else F.when(F.length(value) == length, value)


def condition_of(sample: Column, any_case: bool = False) -> Column:
    """Condition by the last letter of a library's name: i, p or h."""
    last = F.right(sample, F.lit(1))
    last = F.lower(last) if any_case else last
    return F.when(last == "i", "Input").when(last == "p", "IP").when(last == "h", "Control")


def base_id(sample: Column) -> Column:
    """Library name without its condition letter."""
    return F.regexp_replace(sample, "[iIhHpP]$", "")


def site_transcript(site: Column) -> Column:
    """What stands before the last underscore."""
    return F.when(site.rlike("^.*_[^_]+$"), F.regexp_extract(site, "^(.*)_([^_]+)$", 1))


def site_position(site: Column) -> Column:
    """The number after the last underscore."""
    return F.regexp_extract(site, "^(.*)_([^_]+)$", 2).try_cast("int")


def family_key(name: Column) -> Column:
    """Canonical family: lower case, separators as single spaces, nucleolar short names spelled out."""
    x = F.lower(F.trim(name))
    x = F.trim(F.regexp_replace(F.regexp_replace(x, "[-_,]+", " "), " +", " "))
    x = F.regexp_replace(x, "^snord[0-9a-z]*$", "small nucleolar rna c/d box")
    return F.regexp_replace(x, "^snora[0-9a-z]*$", "small nucleolar rna h/aca box")


def sentence_case(text: Column) -> Column:
    """First letter in upper case, the rest as it is."""
    return F.concat(F.upper(F.substring(text, 1, 1)), F.substring(text, F.lit(2), F.length(text)))


def context(seq: Column, pos: Column, flank: int = 7) -> Column:
    """Window of ``2 * flank + 1`` bases around a 1-based position, N beyond the ends; NULL outside the sequence."""
    padded = F.concat(F.lit("N" * flank), seq, F.lit("N" * flank))
    inside = (pos >= 1) & (pos <= F.length(seq))
    return F.when(inside, F.substring(padded, pos, F.lit(2 * flank + 1)))


def center_kmer(seq: Column, k: int) -> Column:
    """The k letters in the middle; NULL for shorter sequences."""
    start = F.floor((F.length(seq) - k) / 2).cast("int") + 1
    return F.when(F.length(seq) >= k, F.substring(seq, start, F.lit(k)))


def valid_kmer(kmer: Column, k: int) -> Column:
    """Whether a k-mer has its length and only the four bases."""
    return F.coalesce(kmer.rlike(f"^[ACGTacgt]{{{k}}}$"), F.lit(False))


def stars(p: Column) -> Column:
    """Significance marks."""
    return F.when(p < 1e-4, "****").when(p < 1e-3, "***").when(p < 1e-2, "**").when(p < 0.05, "*").when(p.isNotNull(), "n.s.")


def shard_index(umi: Column, shards: int = 64) -> Column:
    """The shard of a tag: the CRC-32 of its UTF-8 modulo their number, the same in every run."""
    return (F.crc32(umi.cast("binary")) % shards).cast("int")


def digest_udf(size: int = 16):
    """Arrow UDF: BLAKE2b of a string, as hex; for parity with digests made elsewhere (group by the columns otherwise)."""
    def digest(values: pd.Series) -> pd.Series:
        import hashlib

        return values.map(lambda v: None if v is None else hashlib.blake2b(v.encode(), digest_size=size).hexdigest())

    return F.pandas_udf(digest, "string")


def uniform_udf(seed: int = 1):
    """Arrow UDF: a name's uniform number from BLAKE2b-64 of the name, a pipe character and the seed."""
    def uniform(values: pd.Series) -> pd.Series:
        import hashlib

        return values.map(lambda v: None if v is None else int.from_bytes(hashlib.blake2b(f"{v}|{seed}".encode(), digest_size=8).digest(), "big") / 2**64)

    return F.pandas_udf(uniform, "double")


def uniform_md5(name: Column) -> Column:
    """A name's uniform number from 52 bits of its MD5; other SQL engines compute the same."""
    return F.conv(F.substring(F.md5(name.cast("string")), 1, 13), 16, 10).cast("double") / F.lit(float(2**52))
