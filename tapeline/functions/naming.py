"""File names, camera names, labels as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

# File suffixes, and the marks of low-resolution recordings in file names.
SUFFIX = r"(?i)\.ubv(\.gz)?$"
LOW_RESOLUTION = r"(?i)_2_rotating_|_timelapse_"
BLANKS = r"^\p{IsWhite_Space}+|\p{IsWhite_Space}+$"


def mac_of(name: Column) -> Column:
    return F.nullif(F.upper(F.regexp_extract(name, "^([0-9A-Fa-f]{12})_", 1)), F.lit(""))


def recorded_ms(name: Column) -> Column:
    """Milliseconds at the end of a file name: the part behind the last underscore, thirteen digits long as a number."""
    stem = F.regexp_replace(F.regexp_replace(name, r"(?i)\.gz$", ""), r"(?i)\.ubv$", "")
    last = F.substring_index(stem, "_", -1)
    value = F.when(F.contains(stem, F.lit("_")) & last.rlike(r"^\+?0*[0-9]{1,18}$"), last.try_cast("long"))
    return F.when((value > 10**12) & (value < 10**13), value)


def mac_display(mac: Column) -> Column:
    return F.when(mac.rlike("^[0-9A-Fa-f]{12}$"), F.regexp_replace(F.upper(mac), "(..)(?!$)", "$1:"))


def mac_plain(mac: Column) -> Column:
    return F.upper(F.translate(mac, ":-", ""))


def safe_base(name: Column) -> Column:
    return F.nullif(F.regexp_replace(F.regexp_replace(name, r'[/\\:*?"<>|]', ""), BLANKS, ""), F.lit(""))


def is_low_resolution(name: Column) -> Column:
    return name.rlike(LOW_RESOLUTION)


def is_recording(name: Column) -> Column:
    return name.rlike(SUFFIX)


def file_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def output_name(path: Column, start: Column, extension: Column, folder: Column, base: Column | None = None) -> Column:
    """folder/base_time.extension; the base is the file's stem up to its last underscore, the folder SRC-FOLDER the file's own."""
    stem = F.regexp_replace(file_name(path), r"(?<=.)\.[^.]*$", "")
    base = F.coalesce(base, F.regexp_replace(stem, "_[^_]*$", "")) if base is not None else F.regexp_replace(stem, "_[^_]*$", "")
    time = F.coalesce(F.date_format(start, "yyyy-MM-dd'T'HH.mm.ss'Z'"), F.lit("unknown-time"))
    trimmed = F.regexp_replace(folder, r"[/\\]+$", "")
    parent = F.regexp_extract(path, "^(.*)/[^/]*$", 1)
    into = F.when(trimmed == "SRC-FOLDER", F.when(path.rlike("^/[^/]*$"), F.lit("/")).otherwise(parent)).otherwise(trimmed)
    name = F.concat(base, F.lit("_"), time, F.lit("."), extension)
    return F.when(into == "", name).when(into.endswith("/"), F.concat(into, name)).otherwise(F.concat(into, F.lit("/"), name))


def is_collision(name: Column) -> Column:
    """Whether two outputs have one name."""
    return F.count("*").over(Window.partitionBy(name)) > 1


def size_label(size: Column) -> Column:
    unit = lambda power, digits, name: F.concat(F.format_string(f"%.{digits}f", size / F.lit(float(1 << power))), F.lit(f" {name}"))
    return F.when(size < 1 << 10, F.concat(size.cast("string"), F.lit(" B"))).when(size < 1 << 20, unit(10, 0, "KB")).when(size < 1 << 30, unit(20, 0, "MB")).otherwise(unit(30, 1, "GB"))


def status_label(status: Column, outputs: Column) -> Column:
    done = F.when(outputs == 1, F.lit("Done (1 file)")).when(outputs > 1, F.concat(F.lit("Done ("), outputs.cast("string"), F.lit(" files)"))).otherwise(F.lit("Done"))
    return F.when(status == "Completed", done).when(status == "Processing", F.lit("Processing...")).when(status.isin("Pending", "Failed"), status).otherwise(F.lit("Unknown"))


def display_name(name: Column, mac: Column) -> Column:
    known = F.when(F.trim(name) != "", name)
    return F.coalesce(known, mac_display(mac), mac)


def time_label(ms: Column) -> Column:
    return F.date_format(F.timestamp_millis(ms), "yyyy-MM-dd HH:mm:ss")


def code_label(code: Column) -> Column:
    return F.concat(F.lit("0x"), F.lpad(F.hex(code.cast("long")), 4, "0"))
