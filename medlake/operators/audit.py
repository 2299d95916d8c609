"""Privacy vault, access audits and integrity checks (A6, A7, A12-A21,
A23, A24) as table jobs over logs and listings."""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from medlake.operators.joins import bounded_broadcast
from medlake.session import materialize
from medlake.sources.chunks import CHUNK_BYTES, file_chunks


# ---------------------------------------------------------------- A6 / A7 vault

def tokenize(df: DataFrame, col: str, key: str, vault_name: str = "vault") -> tuple[DataFrame, DataFrame]:
    """Replace ``col`` by a random token per row; the vault holds
    (token, value, key).  The tokens are *written* to the shared checkpoint
    folder and read back before anything joins on them, because a
    re-evaluated ``uuid()`` (task retry, executor loss) would mint new ones.
    Returns (tokenized frame, vault)."""
    with_tok = df.withColumn("__token", F.expr("uuid()"))
    pinned = materialize(with_tok, vault_name)
    vault = pinned.select(F.col("__token").alias("token"), F.col(col).alias("value"), F.col(key).alias("key"))
    out = pinned.drop(col).withColumnRenamed("__token", col)
    return out, vault


def detokenize(df: DataFrame, col: str, vault: DataFrame) -> DataFrame:
    """Map tokens back to values (equi-join on the token)."""
    v = vault.select(F.col("token").alias(col), F.col("value").alias("__value"))
    return df.join(v, col, "left").drop(col).withColumnRenamed("__value", col)


def revoke_consent(vault: DataFrame, revoked: DataFrame, id_col: str = "patient_id", exact: bool = False
                   ) -> DataFrame:
    """Drop vault rows whose value *starts with* a revoked id (the
    reference semantics: 'P1' also removes 'P10...'); ``exact=True`` matches
    whole values.

    The prefix test is an equi-join: each value contributes its prefixes of
    exactly the lengths that revoked ids have (a handful of distinct
    lengths, collected), so the join is on whole keys -- no nested loop and
    no cap on value length."""
    ids = revoked.select(F.col(id_col).alias("__id")).where(F.col("__id").isNotNull()).distinct()
    if exact:
        return vault.join(ids, vault["value"] == ids["__id"], "left_anti")
    lengths = sorted(r[0] for r in ids.select(F.length("__id")).distinct().collect())  # distinct id lengths
    if not lengths:
        return vault
    lens = F.array(*[F.lit(n) for n in lengths])
    pref = vault.select("token", F.explode(F.transform(F.filter(lens, lambda n: n <= F.length("value")),
                                                       lambda n: F.substring("value", 1, n))).alias("__id"))
    hit = pref.join(ids, "__id", "left_semi").select("token").distinct()
    return vault.join(hit, "token", "left_anti")


# ---------------------------------------------------------------- access audits

# fixed values: role grants
ROLE_GRANTS = [("doctor", "patient_records"), ("doctor", "prescriptions"), ("nurse", "vital_signs"),
               ("nurse", "medication_admin")]


def rbac_violations(access: DataFrame, role: str = "role", resource: str = "resource",
                    grants: Sequence[tuple[str, str]] = ROLE_GRANTS) -> DataFrame:
    """Accesses whose (role, resource) is not granted (``left_anti``
    against the small grants table)."""
    g = access.sparkSession.createDataFrame(list(grants), f"{role} string, {resource} string")
    return access.join(F.broadcast(g), [role, resource], "left_anti")


def abac_allowed(clearance: Column, department: Column) -> Column:
    """clearance = high AND department = cardiology (resource ignored)."""
    return F.coalesce((clearance == "high") & (department == "cardiology"), F.lit(False))


def out_of_hours(ts: Column, start: str = "08:00:00", end: str = "18:00:00") -> Column:
    """Event time of day outside [start, end] (inclusive bounds allowed)."""
    def secs(t):
        h, m, s = (int(x) for x in t.split(":"))
        return h * 3600 + m * 60 + s
    sod = F.hour(ts) * 3600 + F.minute(ts) * 60 + F.second(ts)
    return ~sod.between(secs(start), secs(end))


# fixed values: intrusion signatures
INTRUSION_SIGNATURES = ["port_scan", "brute_force", "sql_injection"]


def intrusion_windows(logs: DataFrame, key: str, ts: str, signal: str, window: str = "1 hour",
                      signatures: Sequence[str] = INTRUSION_SIGNATURES) -> DataFrame:
    """Per key and window, whether any log entry equals a signature."""
    hit = F.col(signal).isin(list(signatures))
    return logs.groupBy(key, F.window(F.col(ts).cast("timestamp"), window).start.alias("window_start")).agg(
        F.bool_or(hit).alias("intrusion"), F.count_if(hit).alias("n_hits"))


def list_audit(items: DataFrame, listing: DataFrame, col: str, mode: str = "block") -> DataFrame:
    """Items present in a block list (``left_semi``) or absent from an
    allow list (``left_anti``); the list is broadcast after a size proof."""
    lst = bounded_broadcast(listing.select(col).distinct())
    return items.join(lst, col, "left_semi" if mode == "block" else "left_anti")


TREE_FAN = 1024


def file_hashes(spark, path: str, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """(name, n_bytes, sha256) of every file below a shared folder.

    Files are hashed by byte ranges in parallel; the digests of ``TREE_FAN``
    consecutive ranges are hashed into one until a file has a single digest, so no
    task sees a whole large file or all of its digests.  A file of one range keeps
    its plain SHA-256; of more, ``sha256`` covers the root, the range size and the
    length.  Duplicate names cannot occur; an empty folder gives no rows."""
    nodes = materialize(file_chunks(spark, path, chunk_bytes), "file-chunks").withColumnRenamed("chunk", "i")
    last = nodes.agg(F.max("i").alias("i")).first()["i"] or 0
    nodes = nodes.withColumn("many", F.lit(False))
    while last > 0:
        nodes = nodes.groupBy("name", F.floor(F.col("i") / TREE_FAN).alias("g")).agg(
            F.sum("n_bytes").alias("n_bytes"), F.bool_or("many").alias("many"), F.max("i").alias("top"),
            F.array_sort(F.collect_list(F.struct("i", "digest"))).alias("kids"))      # at most TREE_FAN digests
        joined = F.unhex(F.sha2(F.unhex(F.array_join(F.transform("kids", lambda k: F.hex(k["digest"])), "")), 256))
        alone = F.size("kids") == 1
        nodes = nodes.select("name", F.col("g").alias("i"), "n_bytes", F.when(alone, F.col("kids")[0]["digest"]).otherwise(joined).alias("digest"),
                             (F.col("many") | (F.col("top") > 0)).alias("many"))
        last //= TREE_FAN
    root = F.lower(F.hex("digest"))
    whole = F.sha2(F.concat_ws(":", F.lit("tree"), F.lit(chunk_bytes), F.col("n_bytes"), root), 256)
    return nodes.select("name", "n_bytes", F.when(F.col("many"), whole).otherwise(root).alias("sha256"))


def integrity_diff(current: DataFrame, baseline: DataFrame, name: str = "name") -> DataFrame:
    """Full outer join of file hashes: new / missing / changed / same."""
    b = baseline.select(name, F.col("sha256").alias("base_sha"))
    j = current.join(b, name, "full_outer")
    status = (F.when(F.col("base_sha").isNull(), "new").when(F.col("sha256").isNull(), "missing")
              .when(F.col("sha256") != F.col("base_sha"), "changed").otherwise("same"))
    return j.select(name, status.alias("status"))


def day_digests(log: DataFrame, ts: str, line: Column) -> DataFrame:
    """Per day, an order-independent digest of its lines (xor of 60-bit
    md5 prefixes, plus the line count) -- a map-side partial aggregate,
    no day's lines are ever gathered in one place."""
    h = F.conv(F.substring(F.md5(line), 1, 15), 16, 10).cast("long")
    return log.groupBy(F.to_date(F.col(ts)).alias("day")).agg(F.bit_xor(h).alias("digest"),
                                                              F.count(F.lit(1)).alias("n_lines"))


def hash_chain(digests: DataFrame) -> DataFrame:
    """Chain the day digests: h_d = sha256(h_{d-1} || day || digest || n).
    The chain is sequential over days, so the (one row per day) digest table
    is brought to the driver -- its size is the number of days, not of lines."""
    rows = digests.orderBy("day").collect()
    prev = ""
    out = []
    for r in rows:
        prev = hashlib.sha256(f"{prev}|{r['day']}|{r['digest']}|{r['n_lines']}".encode()).hexdigest()
        out.append((r["day"], int(r["digest"]), int(r["n_lines"]), prev))
    return digests.sparkSession.createDataFrame(out, "day date, digest long, n_lines long, chain string")


def missing_approvals(requests: DataFrame, approvals: str, required: Sequence[str]) -> DataFrame:
    """Requests whose approval set lacks a required approver."""
    req = F.array(*[F.lit(r) for r in required])
    return requests.withColumn("missing", F.array_except(req, F.col(approvals))).where(F.size("missing") > 0)


def config_ok(ssl: Column, firewall: Column, debug: Column) -> Column:
    """Ssl AND firewall AND NOT debug; a missing debug flag counts as True (fail)."""
    return F.coalesce(ssl, F.lit(False)) & F.coalesce(firewall, F.lit(False)) & ~F.coalesce(debug, F.lit(True))


def device_ok(encrypted: Column, passcode: Column, jailbroken: Column) -> Column:
    """Encrypted AND passcode AND NOT jailbroken (missing flags fail)."""
    return (F.coalesce(encrypted, F.lit(False)) & F.coalesce(passcode, F.lit(False))
            & ~F.coalesce(jailbroken, F.lit(True)))


# fixed values: incident response plan by severity
INCIDENT_PLAN = {1: "Low severity: Log and monitor", 2: "Medium: Isolate systems",
                 3: "High: Activate emergency protocol"}


def incident_response(severity: Column) -> Column:
    """Plan text by severity; anything else -> 'Unknown severity level'."""
    m = F.create_map(*[x for k, v in INCIDENT_PLAN.items() for x in (F.lit(k), F.lit(v))])
    return F.coalesce(m[severity], F.lit("Unknown severity level"))


def risk_product(likelihood: Column, impact: Column) -> Column:
    """risk = likelihood x impact."""
    return likelihood * impact


def access_counts(log: DataFrame, user: str, patient: str, ts: str) -> DataFrame:
    """PHI accesses per user, patient and day."""
    return log.groupBy(user, patient, F.to_date(F.col(ts)).alias("day")).agg(F.count(F.lit(1)).alias("n_access"))
