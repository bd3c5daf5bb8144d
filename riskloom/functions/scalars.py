"""Column functions: intervals, logits, keyed tokens, n-grams, similarity. All are built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: 97.5 % quantile of the normal distribution.
Z = 1.959963984540054


def ratio(a: Column, b: Column) -> Column:
    """a / b, NULL where b is 0."""
    return a / F.nullif(b, F.lit(0))


def safe_rate(a: Column, b: Column) -> Column:
    """a / max(b, 1)"""
    return a / F.greatest(b, F.lit(1))


def wilson(hits: Column, total: Column, upper: bool) -> Column:
    """A bound of the Wilson score interval of hits in total; NULL without rows."""
    n = F.nullif(total, F.lit(0)).cast("double")
    p = hits / n
    scale = F.lit(1.0) + Z * Z / n
    centre = (p + Z * Z / (2.0 * n)) / scale
    margin = F.lit(Z) * F.sqrt(p * (F.lit(1.0) - p) / n + Z * Z / (4.0 * n * n)) / scale
    return centre + margin if upper else centre - margin


def clip(p: Column, eps: float) -> Column:
    return F.least(F.greatest(p, F.lit(eps)), F.lit(1.0 - eps))


def logit(p: Column, eps: float = 1e-6) -> Column:
    q = clip(p, eps)
    return F.ln(q / (F.lit(1.0) - q))


def expit(x: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-x))


def prior_shift(p: Column, delta: Column) -> Column:
    """p moved by delta on the logit scale; p itself where delta is 0."""
    return F.when(delta == 0, p).otherwise(expit(logit(p) + delta))


def hmac_sha256(message: Column, key: str) -> Column:
    """HMAC-SHA256 in hex, by its two nested hashes."""
    raw = key.encode()
    if len(raw) > 64:
        raise ValueError("the key must have 64 bytes at most")
    block = raw.ljust(64, b"\0")
    inner, outer = (bytes(b ^ pad for b in block) for pad in (0x36, 0x5C))
    first = F.sha2(F.concat(F.lit(inner), F.encode(message, "UTF-8")), 256)
    return F.sha2(F.concat(F.lit(outer), F.unhex(first)), 256)


def normal_form(value: Column) -> Column:
    """Lower case, letters and digits only."""
    return F.regexp_replace(F.lower(value), r"[^\p{L}\p{N}]", "")


def ngrams(value: Column, n: int = 3) -> Column:
    """Distinct sorted n-grams of a value padded with n - 1 marks on either side."""
    padded = F.concat(F.lit("^" * (n - 1)), value, F.lit("$" * (n - 1)))
    grams = F.transform(F.sequence(F.lit(1), F.length(padded) - n + 1), lambda i: F.substring(padded, i, F.lit(n)))
    return F.array_sort(F.array_distinct(grams))


def dice(a: Column, b: Column) -> Column:
    """2 |A and B| / (|A| + |B|) of two sets; 1 where both are empty."""
    both = F.size(a) + F.size(b)
    return F.when(both == 0, F.lit(1.0)).otherwise(2.0 * F.size(F.array_intersect(a, b)) / both)


def uniform(seed: str, *keys: Column | str) -> Column:
    """A pseudo-random number in [0, 1) from the first 32 bits of a hash of seed and keys; the same in any engine."""
    text = F.concat_ws("|", F.lit(seed), *(F.col(k).cast("string") if isinstance(k, str) else k.cast("string") for k in keys))
    return F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("double") / float(1 << 32)


def right_closed_bin(x: Column, edges: list[float] | Column) -> Column:
    """Number of edges below x, so bins are (a, b]."""
    e = F.array(*(F.lit(float(v)) for v in edges)) if isinstance(edges, list) else edges
    return F.size(F.filter(e, lambda v: v < x))


#: Fixed: the namespace of names that are URLs, in hex.
URL_NAMESPACE = "6ba7b8119dad11d180b400c04fd430c8"


def uuid5(name: Column, namespace: str = URL_NAMESPACE) -> Column:
    """The version-5 UUID of a name: SHA-1 of namespace and name with the bits of version and variant set."""
    h = F.sha1(F.concat(F.unhex(F.lit(namespace)), F.encode(name, "UTF-8")))
    variant = F.substring(F.lit("89ab89ab89ab89ab"), F.conv(F.substring(h, 17, 1), 16, 10).cast("int") + 1, F.lit(1))
    return F.concat(F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-5"), F.substring(h, 14, 3), F.lit("-"), variant, F.substring(h, 18, 3), F.lit("-"), F.substring(h, 21, 12))
