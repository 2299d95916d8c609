"""Secret scans: fixed patterns and a randomness test battery.

Base spans come from three patterns (``assign``, ``access``, ``hex``),
leftmost and non-overlapping per kind; matches that fail their length test are
dropped but still consume their text.

The battery adds spans of kind ``random``.  Candidates are runs of at least
``LEAST`` token characters that hold a digit and a letter and touch no base
span; a run that no encoding holds, since it mixes "+" or "/" with "-" or "_"
(a key after a path), is split at either kind and its parts are candidates, of
overlapping ones the first that looks random.  The narrowest encoding that holds all characters is inferred (hex,
base32, base36, base62, base64); under it the characters of a key are uniform
and independent, which three tests can refute: chi-squared uniformity of the
alphabet, a runs test about the alphabet's middle, and lag-1 serial
correlation.  Their smallest p-value (times three) goes to a
Benjamini-Hochberg procedure at level ``LEVEL``, separately by length class,
since a short run has less power: rejected candidates are ordinary text, the
others are reported if they carry at least ``BITS`` bits.  The procedure sees
all candidates of the corpus as counts in fixed bins of the p-value, so its
size does not grow.

Offsets are code points, ends exclusive.  Results for odd input: null and
empty texts have no spans; repeated rows get equal results; a null id stays
null.  Extra columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from medlake.llm.common import filled, landed, text_slices

KINDS = ("assign", "access", "hex", "random")
LEAST = 20
BITS = 80.0
LEVEL = 0.05
BINS_PER_DECADE, DECADES = 20, 16
#: Lower ends of the length classes.
LENGTHS = (20, 32, 48, 80, 160)

ASSIGN = re.compile(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{16,}")
TOKEN = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{%d,}" % LEAST)
#: Parts of a run between the symbols of one base64 alphabet.
PARTS = (re.compile(r"[^+/]+"), re.compile(r"[^_-]+"))
WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")

#: Alphabets in the order of their symbols' values.
ALPHABETS = {
    "hex": ("0123456789abcdef", "0123456789ABCDEF"),
    "base32": ("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567",),
    "base36": ("0123456789abcdefghijklmnopqrstuvwxyz", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
    "base62": ("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789",),
    "base64": ("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/",
               "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_"),
}
_INDEX = [(name, len(a), {c: i for i, c in enumerate(a)}) for name, many in ALPHABETS.items() for a in many]


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the base patterns, in order."""
    out = []
    low = text.lower()
    if any(w in low for w in WORDS):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 18]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def _upper_tail(z: float) -> float:
    return 0.5 * math.erfc(z / math.sqrt(2))


def battery(token: str) -> tuple[str, float, float] | None:
    """(encoding, bits, p) of one candidate: p is small if it is not random."""
    found = next(((n, k, ix) for n, k, ix in _INDEX if all(c in ix for c in token)), None)
    if found is None:
        return None
    name, k, index = found
    x = np.array([index[c] for c in token], dtype=np.float64)
    n = len(x)
    # chi-squared over the alphabet: mean k - 1, variance 2 (k - 1)(n - 1) / n
    counts = np.bincount(x.astype(int), minlength=k)
    chi = k / n * float((counts.astype(np.float64) ** 2).sum()) - n
    p = [2 * _upper_tail(abs(chi - (k - 1)) / math.sqrt(2 * (k - 1) * (n - 1) / n))]
    # runs above and below the middle of the alphabet
    up = x >= k / 2
    a, b = int(up.sum()), int(n - up.sum())
    if a and b:
        runs = 1 + int((up[1:] != up[:-1]).sum())
        mean = 1 + 2 * a * b / n
        var = (mean - 1) * (mean - 2) / (n - 1)
        p.append(2 * _upper_tail(abs(runs - mean) / math.sqrt(var)) if var > 0 else 1.0)
    else:
        p.append(2.0 ** (1 - n))
    # serial correlation
    y = x - x.mean()
    size = float((y * y).sum())
    r = float((y[1:] * y[:-1]).sum()) / size if size else 1.0
    p.append(2 * _upper_tail(abs(r + 1 / n) * math.sqrt(n)))
    return name, n * math.log2(k), min(1.0, 3 * min(p))


def _candidate(piece: re.Match, base: list[tuple[int, int, int]], at: int = 0) -> dict | None:
    t = piece[0].strip("-_/")
    lo = at + piece.start() + (piece[0].find(t) if t else 0)
    hi = lo + len(t)
    if len(t) < LEAST or not any(c.isdigit() for c in t) or not any(c.isalpha() for c in t):
        return None
    if any(a < hi and lo < b for a, _, b in base):
        return None
    got = battery(t)
    if got and got[1] >= BITS:
        return {"start": lo, "stop": hi, "encoding": got[0], "p": got[2], "cls": sum(len(t) >= n for n in LENGTHS) - 1}
    return None


def candidates(text: str, base: list[tuple[int, int, int]]) -> list[dict]:
    out = []
    for m in TOKEN.finditer(text):
        run = m[0].strip("-_/")
        if ("+" in run or "/" in run) and ("-" in run or "_" in run):
            pieces = [_candidate(q, base, m.start()) for p in PARTS for q in p.finditer(m[0])]
        else:
            pieces = [_candidate(m, base)]
        taken: list[dict] = []
        for c in sorted(filter(None, pieces), key=lambda c: c["p"] < LEVEL):
            if not any(c["start"] < k["stop"] and k["start"] < c["stop"] for k in taken):
                taken.append(c)
        out += sorted(taken, key=lambda c: c["start"])
    return out


_TOKEN_BYTE = np.zeros(256, dtype=bool)
_TOKEN_BYTE[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), 0x2B, 0x2F, 0x5F, 0x2D]] = True
_LEAST_RUN = 16


def _long_runs(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Rows that hold a run of at least ``_LEAST_RUN`` token bytes."""
    rows = np.zeros(len(offs) - 1, bool)
    stop = np.concatenate([[-1], np.flatnonzero(~_TOKEN_BYTE[data]), [len(data)]])
    for i in np.flatnonzero(np.diff(stop) > _LEAST_RUN):
        # a run of bytes may cross rows; mark every row it touches
        a = np.searchsorted(offs, stop[i] + 1, side="right") - 1
        b = np.searchsorted(offs, stop[i + 1] - 1, side="right") - 1
        rows[max(a, 0):b + 1] = True
    return rows


_BASE_T = pa.list_(pa.struct([("start", pa.int64()), ("kind", pa.int32()), ("stop", pa.int64())]))
_CAND_T = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64()), ("encoding", pa.string()), ("p", pa.float64()),
                              ("cls", pa.int32())]))
_SCAN = ("_id long, base array<struct<start:bigint,kind:int,stop:bigint>>, "
         "cands array<struct<start:bigint,stop:bigint,encoding:string,p:double,cls:int>>")


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = filled(batch.column("_text"))
        for lo, hi, data, offs in text_slices(texts):
            runs = _long_runs(data, offs)
            base: list[list] = []
            cands: list[list] = []
            for run, text in zip(runs, texts.slice(lo, hi - lo).to_pylist(), strict=True):
                # an assigned value may be shorter than a run
                spans = base_spans(text) if run or any(w in text.lower() for w in WORDS) else []
                base.append([{"start": a, "kind": k, "stop": b} for a, k, b in spans])
                cands.append(candidates(text, spans) if run else [])
            yield pa.RecordBatch.from_arrays([batch.column("_id").slice(lo, hi - lo), pa.array(base, _BASE_T),
                                              pa.array(cands, _CAND_T)], names=["_id", "base", "cands"])


def p_limits(counts: dict[int, dict[int, int]], level: float = LEVEL) -> dict[int, float]:
    """Largest rejected p by length class, from counts by bin of -log10 p."""
    out = {}
    for cls, bins in counts.items():
        total, seen, limit = sum(bins.values()), 0, 0.0
        for b in sorted(bins, reverse=True):
            seen += bins[b]
            top = 10.0 ** (-b / BINS_PER_DECADE)
            if top <= level * seen / total:
                limit = top
        out[cls] = limit
    return out


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: _id and ``spans``, an ordered array of (start, kind number,
    stop, name), base and added ones."""
    src = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).cast("string").alias("_text"))
    scan = landed(src.mapInArrow(_scan, _SCAN), "secrets")
    top = BINS_PER_DECADE * DECADES
    spot = F.least(F.floor(-F.log10(F.greatest(F.col("c.p"), F.lit(1e-300))) * BINS_PER_DECADE), F.lit(top)).cast("int")
    # at most (length classes) x (bins) rows
    bins = (scan.select(F.explode("cands").alias("c")).groupBy(F.col("c.cls").alias("cls"), F.greatest(spot, F.lit(0)).alias("b"))
            .agg(F.count("*").alias("n")).collect())
    counts: dict[int, dict[int, int]] = {}
    for r in bins:
        counts.setdefault(r["cls"], {})[r["b"]] = r["n"]
    limits = p_limits(counts)

    def limit(cls: Column) -> Column:
        out = F.lit(0.0)
        for k, p in limits.items():
            out = F.when(cls == k, F.lit(p)).otherwise(out)
        return out
    added = F.transform(F.filter("cands", lambda c: c["p"] > limit(c["cls"])),
                        lambda c: F.struct(c["start"].alias("start"), F.lit(3).alias("kind"), c["stop"].alias("stop")))
    spans = F.transform(F.array_sort(F.concat("base", added)), lambda s: F.struct(
        s["start"].alias("start"), s["kind"].alias("kind"), s["stop"].alias("stop"),
        F.element_at(F.array(*[F.lit(k) for k in KINDS]), s["kind"] + 1).alias("name")))
    return scan.select("_id", spans.alias("spans"))


def secret_report(docs: DataFrame) -> DataFrame:
    out = find_secrets(docs)
    base = F.filter("spans", lambda s: s["kind"] < 3)

    def count(k: int):
        return F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long")

    def joined(c):
        return F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["name"], s["start"], s["stop"])), ",")
    return out.select(F.col("_id").alias("doc_id"), count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
                      F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
