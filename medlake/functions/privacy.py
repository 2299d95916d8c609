"""Column-level privacy helpers (A1-A11, A22): hashing, masking,
encryption, signatures and keyword scans, all as built-in expressions."""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def pseudonymize(col, salt: str | None = None) -> Column:
    """A1: sha256 hex of the value (optionally salted)."""
    v = _c(col).cast("string")
    if salt:
        v = F.concat(F.lit(salt), v)
    return F.sha2(v, 256)


def hash_unit(*cols, seed: int = 0) -> Column:
    """A deterministic uniform in [0, 1) from the row's key: the first 48
    bits of md5('seed|k1|k2...').  Stable under retries and repartitioning
    (unlike ``rand``), and reproducible outside Spark."""
    parts = [F.lit(str(seed))] + [_c(c).cast("string") for c in cols]
    h = F.conv(F.substring(F.md5(F.concat_ws("|", *parts)), 1, 12), 16, 10).cast("long")
    return h.cast("double") / float(1 << 48)


def gaussian_noise(col, scale: float, key, seed: int = 0) -> Column:
    """A3: col + N(0, scale) drawn from the row key (Box-Muller on two hash
    uniforms), so the noise of a row does not change when a task is retried
    or partitions move."""
    u1 = F.lit(1.0) - hash_unit(key, seed=seed)  # (0, 1]
    u2 = hash_unit(key, seed=seed + 1)
    z = F.sqrt(F.lit(-2.0) * F.log(u1)) * F.cos(F.lit(2.0 * 3.141592653589793) * u2)
    return _c(col) + F.lit(float(scale)) * z


def mask_tail(col, visible: int = 4, char: str = "*") -> Column:
    """A4: all but the last ``visible`` characters replaced by ``char``;
    strings of length <= visible are returned unchanged."""
    s = _c(col)
    n = F.length(s)
    return F.when(n <= visible, s).otherwise(
        F.concat(F.expr(f"repeat('{char}', length({_sql(col)}) - {int(visible)})"), F.right(s, F.lit(visible))))


def _sql(col) -> str:
    if isinstance(col, str):
        return f"`{col}`"
    raise TypeError("mask_tail needs a column name")


def encrypt(col, key_hex: str) -> Column:
    """AES-256-GCM (iv(12) || ciphertext || tag(16))."""
    return F.aes_encrypt(_c(col).cast("binary"), F.unhex(F.lit(key_hex)), F.lit("GCM"))


def decrypt(col, key_hex: str) -> Column:
    return F.aes_decrypt(_c(col), F.unhex(F.lit(key_hex)), F.lit("GCM")).cast("string")


def hmac_sha256(col, key: str) -> Column:
    """HMAC-SHA256 hex digest of the UTF-8 value (RFC 2104):
    H((K ^ opad) || H((K ^ ipad) || m)); a key longer than the 64-byte block
    is hashed first."""
    kb = key.encode("utf-8")
    if len(kb) > 64:
        kb = hashlib.sha256(kb).digest()
    kb = kb.ljust(64, b"\0")
    ipad = bytes(b ^ 0x36 for b in kb).hex()
    opad = bytes(b ^ 0x5C for b in kb).hex()
    inner = F.unhex(F.sha2(F.concat(F.unhex(F.lit(ipad)), _c(col).cast("binary")), 256))
    return F.sha2(F.concat(F.unhex(F.lit(opad)), inner), 256)


# fixed values: data-loss-prevention keywords
DLP_KEYWORDS = ["diagnosis", "treatment", "medical_history"]


def keyword_hits(col, keywords: Sequence[str] = DLP_KEYWORDS) -> Column:
    """A10: array of the keywords contained in the lower-cased text."""
    low = F.lower(_c(col))
    return F.filter(F.array(*[F.when(F.contains(low, F.lit(k)), F.lit(k)) for k in keywords]),
                    lambda x: x.isNotNull())


def contains_any(col, needles: Sequence[str], lower: bool = True) -> Column:
    """Text contains any needle."""
    s = F.lower(_c(col)) if lower else _c(col)
    out = F.lit(False)
    for n in needles:
        out = out | F.contains(s, F.lit(n.lower() if lower else n))
    return out


def sanitize(col) -> Column:
    """Remove ``;``, backslash, quotes, ``<`` and ``>``."""
    return F.regexp_replace(_c(col), "[;\\\\'\"<>]", "")


# fixed values: suspicious code patterns
SUSPICIOUS_CODE = ["eval(", "exec(", "os.system("]
