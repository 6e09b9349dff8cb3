"""Column functions over object ids, paths, components and hashes.

Paths are bytes; as strings they are kept in ISO-8859-1, which loses nothing and keeps byte order. Plain UTF-8 paths
may stay as they are."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Domain tags that keep the hashes of different uses apart; whoever must match another producer's ids passes its tag.
CANDIDATE_TAG = "candidate-v1"
SHUFFLE_TAG = "shuffle-v1"
REVIEW_TAG = "review-v1"
# Fixed value: the mode of a gitlink.
GITLINK = "160000"

WEIGHTS = ("unit", "inverse-component", "pair-normalized")


def latin(path: Column) -> Column:
    """Path bytes as a string of one character a byte."""
    return F.decode(path, "ISO-8859-1")


def is_object_id(col: Column) -> Column:
    """40 lower-case hex digits and nothing else (a final line feed isn't one)."""
    return F.coalesce((F.length(col) == 40) & col.rlike("^[0-9a-f]{40}$"), F.lit(False))


def event_kind(n_parents: Column) -> Column:
    return F.when(n_parents == 0, "root").when(n_parents == 1, "single-parent").when(n_parents >= 2, "merge-result")


def is_gitlink(src_mode: Column, dst_mode: Column) -> Column:
    return (src_mode == GITLINK) | (dst_mode == GITLINK)


def is_vendor_path(path: Column) -> Column:
    """Any segment is exactly `vendor`."""
    return F.array_contains(F.split(path, "/"), "vendor")


def component_of(path: Column) -> Column:
    """The parent directory; `.` for a file at the root. Nothing is cleaned or folded."""
    name = F.substring_index(path, "/", -1)
    return F.when(F.instr(path, "/") == 0, F.lit(".")).otherwise(F.left(path, F.length(path) - F.length(name) - 1))


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def size_weight(mode: Column, k: Column) -> Column:
    """What a transaction of k components weighs."""
    one, k = F.lit(1), k.cast("bigint")
    return (
        F.when(mode == WEIGHTS[0], F.lit(1.0))
        .when(mode == WEIGHTS[1], F.lit(1.0) / F.greatest(one, k - 1))
        .when(mode == WEIGHTS[2], F.lit(1.0) / F.greatest(one, k * (k - 1)))
    )


def base64url(data: Column) -> Column:
    """Unpadded; Spark's base64 breaks lines, which is undone here."""
    plain = F.regexp_replace(F.base64(data.cast("binary")), "[\\r\\n=]", "")
    return F.translate(plain, "+/", "-_")


def byte_identity(path: Column) -> Column:
    """Path bytes as {bytes_b64url, display}; display is null unless the bytes are UTF-8."""
    text = path.cast("binary").cast("string")
    return F.struct(base64url(path).alias("bytes_b64url"), F.when(F.is_valid_utf8(text), text).alias("display"))


def joined_hash(*fields: Column | str) -> Column:
    """SHA-256 over the fields joined by single NUL bytes."""
    cols = [F.lit(f) if isinstance(f, str) else f.cast("string") for f in fields]
    return F.sha2(F.concat_ws("\0", *cols).cast("binary"), 256)


def candidate_id(antecedent: Column, consequent: Column, tag: str = CANDIDATE_TAG) -> Column:
    return joined_hash(tag, "inferred", base64url(antecedent), base64url(consequent))


def profile_candidate_id(tier: Column, rule: Column, tag: str = CANDIDATE_TAG) -> Column:
    return joined_hash(tag, "profile", tier, rule)


def review_hash(repository: Column, kind: str, *fields: Column | str, tag: str = REVIEW_TAG) -> Column:
    """The order of review units: kind is inferred-candidate, deviation or profile-candidate."""
    return joined_hash(tag, repository, kind, *fields)


def six(value: Column) -> Column:
    """Six decimals; -0 shows as 0."""
    return F.format_string("%.6f", value + F.lit(0.0))


def metric(value: Column, reason: Column) -> Column:
    """{value, reason}: a finite number as a six-decimal string, or null and why."""
    bad = value.isNull() | F.isnan(value) | (F.abs(value) == F.lit(float("inf")))
    return F.struct(F.when(~bad, six(value)).alias("value"), F.when(bad, reason).alias("reason"))


def escape_control(text: Column) -> Column:
    """Control and terminal characters as \\xNN and the backslash doubled, so that no two texts show alike."""
    return F.array_join(
        F.transform(
            F.split(text, ""),
            lambda c: F.when(c.rlike("[\\x00-\\x1F\\x7F-\\x9F]"), F.concat(F.lit("\\x"), F.lower(F.lpad(F.hex(F.ascii(c)), 2, "0")))).when(c == "\\", "\\\\").otherwise(c),
        ),
        "",
    )
