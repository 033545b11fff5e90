"""Scalar functions as Column expressions: everything here stays in generated JVM code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: File name extensions by kind.
IMAGE_EXTS = "jpg jpeg jpe jfif png gif bmp tif tiff webp heic heif avif dng cr2 nef arw jp2 ico".split()
VIDEO_EXTS = "mp4 m4v mov avi mkv webm wmv flv mpg mpeg 3gp 3g2 mts m2ts ts vob".split()
ARCHIVE_EXTS = "zip tar gz tgz bz2 xz 7z rar".split()
DOCUMENT_EXTS = "pdf doc docx eml msg html htm mht mhtml odt xls xlsx ppt pptx".split()
#: Hashes of empty content.
EMPTY_HASHES = {
    "md5": "d41d8cd98f00b204e9800998ecf8427e",
    "sha1": "da39a3ee5e6b4b0d3255bfef95601890afd80709",
    "sha256": "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855",
}
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def ascii_lower(x: Column | str) -> Column:
    """Folds A-Z only."""
    return F.translate(_c(x), _UPPER, _LOWER)


def contains_folded(x: Column | str, text: str) -> Column:
    """Whether the text occurs literally, A-Z folded; wildcards are ordinary characters."""
    return F.contains(ascii_lower(x), F.lit("".join(c.lower() if c in _UPPER else c for c in text)))


def hexbits(x: Column | str) -> Column:
    """16 hex digits as a 64-bit pattern in a BIGINT; anything else is null."""
    return F.when(_c(x).rlike("^[0-9a-fA-F]{16}$"), F.conv(_c(x), 16, -10).cast("long"))


def distance(a: Column, b: Column) -> Column:
    """Differing bits of two patterns, 999 if either is missing."""
    return F.coalesce(F.bit_count(a.bitwiseXOR(b)), F.lit(999))


def meaningful(bits: Column) -> Column:
    """Whether a perceptual hash says anything: 12 to 52 of its bits are set."""
    return F.bit_count(bits).between(12, 52)


def similarity_percent(d: Column) -> Column:
    return F.bround(100.0 * (1 - d / 64.0), 1)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays in double precision; 0 if either is all zero."""
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    norm = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    both = norm(a) * norm(b)
    return F.when(both == 0, 0.0).otherwise(dot / both)


def kind_of_ext(ext: Column | str) -> Column:
    e = F.lower(F.regexp_replace(_c(ext), r"^\.", ""))
    return F.when(e.isin(IMAGE_EXTS), "image").when(e.isin(VIDEO_EXTS), "video").when(e.isin(ARCHIVE_EXTS), "archive").otherwise("other")


def kind_of_mime(ext: Column | str, mime: Column | str) -> Column:
    """The extension decides; a media type only where the extension says nothing."""
    by_ext, m = kind_of_ext(ext), F.lower(F.trim(_c(mime)))
    return F.when(by_ext != "other", by_ext).when(m.startswith("video/"), "video").when(m.startswith("image/"), "image").otherwise("other")


#: Leading bytes (hex) by the kind they show; brands (hex) of RIFF forms and of ISO base media files, the rest of which are other and video.
LEADING_BYTES = {
    "archive": "4C5A4300 434D4D4D 504B0304 504B0506 1F8B 425A68 FD377A585A00 377ABCAF271C 52617221".split(),
    "image": "FFD8FF 89504E470D0A1A0A 474946383761 474946383961 424D 49492A00 4D4D002A 0000000C6A5020200D0A870A FF4FFF51".split(),
    "video": "1A45DFA3 464C56".split(),
}
RIFF_FORMS = {"WEBP": "image", "AVI ": "video"}
ISO_BRANDS = {b: "image" for b in "heic heix heim heis hevc hevx hevm hevs mif1 mif2 msf1 miaf MiHE avif avis".split()} | {b: "other" for b in ("M4A ", "M4B ", "M4P ")}


def sniff_kind(content: Column | str) -> Column:
    """image, video, archive or other from the first 16 bytes."""
    head = F.substring(_c(content), 1, 16)
    first, name = F.hex(head), F.decode(F.substring(head, 9, 4), "ISO-8859-1")
    kind_of = lambda names: F.element_at(F.create_map(*[F.lit(x) for pair in names.items() for x in pair]), name)
    by_bytes = [F.when(F.greatest(*[first.startswith(x).cast("int") for x in found]) == 1, kind) for kind, found in LEADING_BYTES.items()]
    boxed = F.when(F.substring(head, 1, 4) == F.lit(b"RIFF"), F.coalesce(kind_of(RIFF_FORMS), F.lit("other"))).when(F.substring(head, 5, 4) == F.lit(b"ftyp"), F.coalesce(kind_of(ISO_BRANDS), F.lit("video")))
    return F.coalesce(*by_bytes, boxed, F.lit("other"))


def valid_place(lat: Column, lon: Column) -> Column:
    return lat.isNotNull() & lon.isNotNull() & ~F.isnan(lat) & ~F.isnan(lon) & (F.abs(lat) <= 90) & (F.abs(lon) <= 180) & ~((lat == 0) & (lon == 0))


def degrees_of_parts(text: Column, ref: Column) -> Column:
    """One to three numbers (degrees, minutes, seconds) with a compass letter; null without a real one."""
    parts = F.transform(F.regexp_extract_all(text, F.lit(r"(\d+(?:\.\d+)?)"), F.lit(1)), lambda x: x.cast("double"))
    at = lambda i: F.coalesce(F.try_element_at(parts, F.lit(i)), F.lit(0.0))
    sign = F.when(F.upper(F.substring(F.trim(ref), 1, 1)).isin("N", "E"), 1).when(F.upper(F.substring(F.trim(ref), 1, 1)).isin("S", "W"), -1)
    return F.when(F.size(parts).between(1, 3), F.round(sign * (at(1) + at(2) / 60 + at(3) / 3600), 7))


def xmp_degrees(text: Column) -> Column:
    """``DDD,MM.mmk`` or ``DDD,MM,SSk`` with k one of N, S, E, W."""
    whole = text.rlike(r"^\s*\d+(\.\d+)?(,\d+(\.\d+)?){0,2}\s*[NSEWnsew]\s*$")
    return F.when(whole, degrees_of_parts(text, F.regexp_extract(text, "([NSEWnsew])", 1)))


def iso6709(text: Column, which: int) -> Column:
    """Latitude (which=1) or longitude (which=2) of an ISO 6709 string, by the number of whole digits."""
    p = r"^\s*([+-])(\d+)((?:\.\d+)?)([+-])(\d+)((?:\.\d+)?)"
    sign, whole, frac = (F.regexp_extract(text, p, i + 3 * (which - 1)) for i in (1, 2, 3))
    d = 2 if which == 1 else 3
    cut = lambda a, n: F.substring(whole, a, n)
    number = lambda x: x.cast("double")
    rest = F.length(whole) - d
    value = (
        F.when(rest == 0, F.concat(whole, frac).try_cast("double"))
        .when(rest == 2, number(cut(1, d)) + F.concat(F.substring(whole, d + 1, 2), frac).try_cast("double") / 60)
        .when(rest == 4, cut(1, d).try_cast("double") + F.substring(whole, d + 1, 2).try_cast("double") / 60 + F.concat(F.substring(whole, d + 3, 2), frac).try_cast("double") / 3600)
    )
    return F.when(text.rlike(p), F.round(F.when(sign == "-", -value).otherwise(value), 7))


def exif_time(text: Column) -> Column:
    """``YYYY:MM:DD hh:mm:ss`` or with hyphens as ISO text, null if impossible; never an instant."""
    t = F.regexp_replace(F.trim(text), r"^(\d{4})[:-](\d{2})[:-](\d{2})[ T]", "$1-$2-$3 ")
    return F.when(t.rlike(r"^\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}$"), F.date_format(F.try_to_timestamp(t, F.lit("yyyy-MM-dd HH:mm:ss")), "yyyy-MM-dd'T'HH:mm:ss"))


def text_of_size(n: Column) -> Column:
    """Bytes with a binary unit and one decimal; whole bytes without one."""
    unit = lambda k, name: F.format_string(f"%.1f {name}", F.bround(n / float(1024**k), 1))
    return F.when(n < 1024, F.format_string("%d B", n)).when(n < 1024**2, unit(1, "KB")).when(n < 1024**3, unit(2, "MB")).when(n.isNotNull(), unit(3, "GB"))


def text_of_duration(seconds: Column) -> Column:
    """h:mm:ss, or m:ss under an hour; blank without a duration."""
    s = F.floor(F.coalesce(seconds, F.lit(0.0))).cast("long")
    hms = F.format_string("%d:%02d:%02d", F.floor(s / 3600), F.floor(s / 60) % 60, s % 60)
    return F.when(s <= 0, "").when(s >= 3600, hms).otherwise(F.format_string("%d:%02d", F.floor(s / 60), s % 60))


def algorithm_of(value: Column) -> Column:
    v = F.trim(value)
    return F.when(v.rlike("^[0-9a-fA-F]+$"), F.when(F.length(v) == 32, "md5").when(F.length(v) == 40, "sha1").when(F.length(v) == 64, "sha256"))


def storable(algo: Column, value: Column) -> Column:
    """A list entry as it is kept: trimmed, in lower case, of the right length, not the hash of empty content; else null. PhotoDNA keeps its case."""
    a, v = F.lower(F.trim(algo)), F.regexp_replace(value, r"^\s+|\s+$", "")
    low = F.lower(v)
    size = F.when(a == "md5", 32).when(a == "sha1", 40).when(a == "sha256", 64).when(a == "phash", 16)
    fine = low.rlike("^[0-9a-f]+$") & (F.length(low) == size) & ~low.isin(*EMPTY_HASHES.values())
    return F.when(a == "photodna", F.when(v != "", v)).when(fine, low)


#: Folders under which one stored file may appear (# is the user's number) and the class of storage, in order of preference.
STORAGE_VIEWS = {
    "data/data": "ce", "data/user_de/#": "de", "data/user/#": "ce", "data_mirror/data_ce/*/#": "ce", "data_mirror/data_de/*/#": "de",
    "data/media/#": "media", "storage/emulated/#": "media", "mnt/user/#/emulated/#": "media", "sdcard": "media",
}


def storage_view(path: Column) -> Column:
    """struct(prefix, storage, user, rest, rank) of a path below such a folder, else null; spellings of one file agree in all but rank.

    The folder nearest the beginning counts.
    """
    shapes = "|".join(v.replace("*", "[^/]+").replace("#", r"\d+") for v in sorted(STORAGE_VIEWS, key=len, reverse=True))
    whole = f"^((?:.*?/)?)({shapes})/(.*)$"
    p = F.replace(path, F.lit("\\"), F.lit("/"))
    prefix, folder, rest = (F.regexp_extract(p, whole, i) for i in (1, 2, 3))
    volumeless = F.regexp_replace(folder, "^(data_mirror/[^/]+)/[^/]+/", "$1/*/")
    shape = F.regexp_replace(volumeless, r"/\d+(?=/|$)", "/#")
    user = F.regexp_extract(volumeless, r"/(\d+)(?=/|$)", 1)
    named = F.create_map(*[x for i, (v, c) in enumerate(STORAGE_VIEWS.items()) for x in (F.lit(v), F.struct(F.lit(c).alias("storage"), F.lit(i).alias("rank")))])
    of = F.element_at(named, shape)
    return F.when(folder != "", F.struct(prefix.alias("prefix"), of["storage"].alias("storage"), F.when(user == "", "0").otherwise(user).alias("user"), rest.alias("rest"), of["rank"].alias("rank")))


#: Folders of the system's and applications' own artwork, as LIKE patterns over the path in lower case with slashes.
SYSTEM_FOLDERS = ("%/windows/%", "%/program files%", "%/programdata/%", "%/system/library/%", "%/applications/%.app/%")


def is_system_path(path: Column) -> Column:
    p = F.replace(F.lower(F.coalesce(path, F.lit(""))), F.lit("\\"), F.lit("/"))
    out = F.lit(False)
    for pattern in SYSTEM_FOLDERS:
        out = out | p.like(pattern)
    return out


def tri_state(text: Column) -> Column:
    """true or 1, false or 0 (in any case, white space round them ignored) as a boolean, anything else as null."""
    t = F.lower(F.trim(text))
    return F.when(t.isin("true", "1"), True).when(t.isin("false", "0"), False)


def pack_flags(*flags: Column) -> Column:
    """Up to eight three-valued flags as one number: bit i says that flag i is there, bit 8 + i that it is true; null if none is."""
    bits = [F.when(f.isNull(), 0).when(f, (1 << i) | (1 << (8 + i))).otherwise(1 << i) for i, f in enumerate(flags)]
    out = bits[0]
    for b in bits[1:]:
        out = out + b
    return F.when(out != 0, out)


def unpack_flag(packed: Column, i: int) -> Column:
    """Flag i of ``pack_flags``: true, false or null."""
    return F.when(packed.bitwiseAND(1 << i) != 0, packed.bitwiseAND(1 << (8 + i)) != 0)


def bits_of_hex(text: Column, words: int = 4) -> Column:
    """16 * words hex digits as an array of 64-bit patterns, else null."""
    parts = F.array(*[F.conv(F.substring(text, 1 + 16 * i, 16), 16, -10).cast("long") for i in range(words)])
    return F.when(text.rlike(f"^[0-9a-fA-F]{{{16 * words}}}$"), parts)


def distance_of_arrays(a: Column, b: Column) -> Column:
    """Differing bits of two arrays of 64-bit patterns of the same length."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda n, x: n + x)


def capture_time(text: Column) -> Column:
    """``M/d/yyyy h:mm:ss AM`` or ``M/d/yyyy H:mm:ss`` as ISO text; a trailing ``(UTC+h[:mm])`` is kept as an offset; null if impossible."""
    end = r"\s*\(UTC([+-])(\d{1,2})(?::(\d{2}))?\)\s*$"
    bare = F.trim(F.regexp_replace(text, end, ""))
    at = F.coalesce(F.try_to_timestamp(bare, F.lit("M/d/yyyy h:mm:ss a")), F.try_to_timestamp(bare, F.lit("M/d/yyyy H:mm:ss")))
    minutes = F.regexp_extract(text, end, 3)
    offset = F.when(text.rlike(end), F.concat(F.regexp_extract(text, end, 1), F.lpad(F.regexp_extract(text, end, 2), 2, "0"), F.lit(":"), F.when(minutes == "", "00").otherwise(minutes))).otherwise("")
    return F.concat(F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss"), offset)


def shown_in_zone(epoch: Column, zone: str) -> Column:
    """Epoch seconds as a clock in ``zone`` shows them; 0, NaN and null are no time."""
    at = F.timestamp_micros((epoch * 1_000_000).cast("long"))
    return F.when(epoch.isNotNull() & ~F.isnan(epoch) & (epoch != 0), F.date_format(F.from_utc_timestamp(at, zone), "yyyy-MM-dd HH:mm:ss"))


#: Fixed value: what a local path in a message becomes.
HIDDEN_PATH = "<path>"


def without_paths(text: Column) -> Column:
    """A message without the local paths in it: of a drive, a share or the root."""
    return F.regexp_replace(text, r"""(?:[A-Za-z]:\\|\\\\|(?<![\w/])/)[^\s'":;,]+""", HIDDEN_PATH)


def world_x(lon: Column, zoom: int) -> Column:
    """Web-Mercator pixel column at a zoom, 256 pixels a tile."""
    return (lon + 180) / 360 * float(256 << zoom)


def world_y(lat: Column, zoom: int) -> Column:
    s = F.sin(F.radians(F.least(F.greatest(lat, F.lit(-85.05112878)), F.lit(85.05112878))))
    return (0.5 - F.log((1 + s) / (1 - s)) / (4 * F.pi())) * float(256 << zoom)


def tile_id(zoom: int, x: Column, y: Column) -> Column:
    """The number of a tile along a Hilbert curve after all tiles of smaller zooms."""
    base = ((1 << (2 * zoom)) - 1) // 3
    start = F.struct(F.lit(0).cast("long").alias("d"), x.cast("long").alias("x"), y.cast("long").alias("y"))

    def step(a: Column, i: Column) -> Column:
        s = F.pow(F.lit(2.0), (zoom - 1) - i).cast("long")
        rx = (a["x"].bitwiseAND(s) > 0).cast("long")
        ry = (a["y"].bitwiseAND(s) > 0).cast("long")
        d = a["d"] + s * s * (3 * rx).bitwiseXOR(ry)
        fx = F.when((ry == 0) & (rx == 1), s - 1 - a["x"]).otherwise(a["x"])
        fy = F.when((ry == 0) & (rx == 1), s - 1 - a["y"]).otherwise(a["y"])
        return F.struct(d.alias("d"), F.when(ry == 0, fy).otherwise(fx).alias("x"), F.when(ry == 0, fx).otherwise(fy).alias("y"))

    if zoom == 0:
        return F.lit(base).cast("long")
    return F.aggregate(F.sequence(F.lit(0), F.lit(zoom - 1)), start, step, lambda a: a["d"] + base)


def real_prefix(text: Column) -> Column:
    """The number a text begins with, else 0: how a lenient cast to a real reads it."""
    return F.coalesce(F.regexp_extract(text, r"^\s*([+-]?\d+(?:\.\d+)?(?:[eE][+-]?\d+)?)", 1).try_cast("double"), F.lit(0.0))


def base_name(path: Column) -> Column:
    return F.element_at(F.split(F.replace(path, F.lit("\\"), F.lit("/")), "/"), -1)
