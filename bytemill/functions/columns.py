"""Column expressions of the engine; nothing here leaves the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Content classes and the stage masks that go with them.
TEXT, STRUCTURED, RANDOM, COMPRESSED = "text", "binary-structured", "binary-random", "already-compressed"
STAGES = {TEXT: 0x3F, STRUCTURED: 0x7F, RANDOM: 0x33, COMPRESSED: 0x03}
ALL_STAGES, BITPACK = 0xFF, 0x80
ERRORS = {0: "OK", -1: "Invalid argument", -2: "I/O error", -3: "Corrupt data", -4: "CRC32 mismatch", -5: "Out of memory", -6: "Not found", -7: "Internal error"}


def content_class(printable: Column, entropy: Column, distinct: Column) -> Column:
    """In this order, with strict bounds: mostly printable, compressed, random, else structured."""
    return (
        F.when(printable > 0.90, TEXT)
        .when((entropy > 7.9) & (distinct > 250), COMPRESSED)
        .when(entropy > 7.5, RANDOM)
        .otherwise(STRUCTURED)
    )


def stage_mask(kind: Column, distinct: Column, length: Column) -> Column:
    """The recommended stages; few distinct bytes add bit packing, an empty blob gets all."""
    mask = F.when(length == 0, ALL_STAGES)
    for name, bits in STAGES.items():
        more = F.when(distinct <= 16, bits | BITPACK).otherwise(bits) if name != COMPRESSED else F.lit(bits)
        mask = mask.when(kind == name, more)
    return mask.cast("int")


def class_name(code: Column) -> Column:
    out = F
    for k, name in enumerate((TEXT, STRUCTURED, RANDOM, COMPRESSED)):
        out = out.when(code == k, name)
    return out.otherwise("unknown")


def predicted_ratio(entropy: Column) -> Column:
    return F.when(entropy <= 0.001, 0.001).otherwise(F.least(F.lit(1.0), entropy / 8.0 * 1.2))


def ratio(compressed: Column, original: Column) -> Column:
    return F.when(original == 0, 0.0).otherwise(compressed / original)


def size_text(n: Column) -> Column:
    """Bytes as B, KB, MB or GB, with two digits from KB on; halves go to the even digit."""
    out = F.when(n < 1024, F.concat(n.cast("string"), F.lit(" B")))
    for power, unit in ((1, "KB"), (2, "MB")):
        out = out.when(n < 1024 ** (power + 1), F.format_string(f"%.2f {unit}", F.bround(n / float(1024**power), 2)))
    return out.otherwise(F.format_string("%.2f GB", F.bround(n / float(1024**3), 2)))


def error_text(code: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in ERRORS.items() for x in pair])
    return F.coalesce(F.try_element_at(table, code), F.lit("Unknown error"))


def archive_name(path: Column) -> Column:
    return F.concat(path, F.lit(".cell"))


def restored_name(path: Column) -> Column:
    return F.when(path.endswith(".cell"), F.regexp_replace(path, r"\.cell$", "")).otherwise(F.concat(path, F.lit(".out")))


def bits_needed(distinct: Column, length: Column) -> Column:
    bits = F.when(distinct <= 2, 1).when(distinct <= 4, 2).when(distinct <= 16, 4).when(distinct <= 64, 6).otherwise(8)
    packed = 6 + distinct + F.ceil(length * bits / 8.0)
    return F.when((length == 0) | (packed >= length), 8).otherwise(bits).cast("int")


def density(original_bits: Column, cells: Column, bits: Column) -> Column:
    return F.when(cells * bits == 0, 0.0).otherwise(original_bits / (cells * bits))


def chunker_mask(target: Column) -> Column:
    """As many low bits as the target size has doublings."""
    return F.call_function("shiftleft", F.lit(1).cast("long"), F.floor(F.log2(target)).cast("int")) - 1
