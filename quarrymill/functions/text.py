"""Scalar functions over text columns, all JVM-side but the compatibility normaliser."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

#: File extensions by kind of source and by kind of attachment.
SOURCE_KINDS = {
    "pdf": [".pdf"],
    "excel": [".xlsx", ".xls", ".xlsm"],
    "office": [".docx", ".docm", ".doc", ".pptx", ".ppt"],
    "markdown": [".md", ".markdown", ".txt"],
    "code": [".py", ".c", ".h", ".cpp", ".js", ".ts", ".java", ".cs", ".go", ".rs", ".bat", ".sh"],
}
ATTACHMENT_KINDS = {
    "image": [".png", ".jpg", ".jpeg", ".gif", ".bmp", ".webp"],
    "video": [".mp4", ".avi", ".mov", ".mkv", ".wmv", ".flv"],
    "dbc": [".dbc"],
    "blf": [".blf"],
    "archive": [".gz", ".tgz", ".zip", ".7z", ".tar"],
    "log": [".log", ".curf", ".txt", ".csv"],
}
#: Radicals that compatibility normalisation leaves, symbols of private-use fonts, wide marks that stay.
RADICALS = {0x2EC5: "见", 0x2EC6: "角", 0x2ECB: "车", 0x2ED3: "长", 0x2ED4: "门", 0x2EDB: "风", 0x2EE9: "黄"}
PRIVATE_SYMBOLS = {0xF06C: "·", 0xF0B7: "·", 0xF0A7: "■", 0xF075: "◆", 0xF0FC: "·", 0xF0D8: "→", 0xF0E0: "→"}
WIDE_MARKS = "，。、；：？！（）【】〔〕《》〈〉「」『』“”‘’—…～·　"
#: Fixed value: extensions of file names that identifiers are not read from.
FILE_TOKENS = "png|jpg|jpeg|gif|bmp|webp|log|txt|blf|dbc|gz|zip|csv|xlsx|docx|pdf"


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def extension(path: Column | str) -> Column:
    """Lower-cased, with its dot; empty for none or a leading dot alone."""
    name = F.regexp_extract(_c(path), r"([^/]*)$", 1)
    return F.lower(F.regexp_extract(name, r"[^.](\.[^.]*)$", 1))


def source_kind(path: Column | str) -> Column:
    out, ext = None, extension(path)
    for kind, suffixes in SOURCE_KINDS.items():
        out = (F if out is None else out).when(ext.isin(suffixes), kind)
    return out.otherwise("other")


def has_frame(content: Column | str) -> Column:
    """A frame head as hexadecimal text; binary columns should be decoded as ISO-8859-1."""
    return _c(content).rlike(r"(?:0[xX])?5[aA]\s+(?:0[xX])?[aA]5")


def attachment_kind(name: Column | str, content: Column | None = None) -> Column:
    """image, video, dbc, blf, archive, log5aa5, log_other or unknown, by name and then by content."""
    name, ext = _c(name), extension(name)
    framed = F.coalesce(has_frame(content), F.lit(False)) if content is not None else F.lit(False)
    log = ext.isin(ATTACHMENT_KINDS["log"]) | F.lower(name).rlike(r"\.log\.\d+$") | ((ext == "") & ~name.startswith(".") & (name != ""))
    out = F.when(ext.isin(ATTACHMENT_KINDS["image"]), "image")
    for kind in ("video", "dbc", "blf"):
        out = out.when(ext.isin(ATTACHMENT_KINDS[kind]), kind)
    out = out.when(ext.isin(ATTACHMENT_KINDS["archive"]) | F.lower(name).rlike(r"\.tar\.(bz2|xz)$"), "archive")
    return out.when(log, F.when(framed, "log5aa5").otherwise("log_other")).when(framed, "log5aa5").otherwise("unknown")


def cell(c: Column | str) -> Column:
    """Safe in a Markdown table cell."""
    s = F.replace(F.replace(F.coalesce(_c(c), F.lit("")), F.lit("\\n"), F.lit(" ")), F.lit("\n"), F.lit("<br>"))
    return F.trim(F.regexp_replace(F.translate(s, "|\u00a0", "/ "), "[ \t]+", " "))


def table_row(*cells: Column | str) -> Column:
    return F.concat(F.lit("| "), F.concat_ws(" | ", *[cell(c) for c in cells]), F.lit(" |"))


def slug(c: Column | str) -> Column:
    """ASCII slug: runs of anything else become one hyphen; `mod` where nothing is left."""
    s = F.regexp_replace(F.regexp_replace(F.lower(_c(c)), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return F.when(s == "", "mod").otherwise(s)


def unicode_slug(c: Column | str) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(_c(c))), r"(?U)[^\w\s-]", ""), r"(?U)\s+", "-")


def safe_name(c: Column | str, most: int = 80) -> Column:
    return F.substring(F.trim(F.translate(_c(c), '\\/:*?"<>|', "_" * 9)), 1, most)


def code_block(c: Column | str, language: Column | str) -> Column:
    return F.concat(F.lit("```"), F.coalesce(_c(language), F.lit("")), F.lit("\n"), F.rtrim(_c(c), F.lit("\n")), F.lit("\n```\n"))


def truncated(c: Column | str, most: int, marker: str = "…") -> Column:
    """marker may hold {n}, the full length."""
    c = _c(c)
    n = F.length(c).cast("string")
    end = F.replace(F.lit(marker), F.lit("{n}"), n) if "{n}" in marker else F.lit(marker)
    return F.when(F.length(c) > most, F.concat(F.substring(c, 1, most), end)).otherwise(c)


def hex_id(c: Column | str) -> Column:
    """`0x` and lower-case digits without leading zeros."""
    t = F.regexp_replace(F.regexp_replace(F.lower(F.trim(_c(c))), "^0x", ""), "^0+", "")
    return F.concat(F.lit("0x"), F.when(t == "", "0").otherwise(t))


#: What an identifier and a clock time look like in a text, and dates and times that hold no identifier.
DATE_OR_TIME = r"\d{4}[-/]\d{1,2}[-/]\d{1,2}|\d{1,2}:\d{2}(?::\d{2})?"
PREFIXED_ID, BARE_ID = r"0x([0-9A-Fa-f]{1,4})(?![0-9A-Fa-f])", r"(?<![0-9A-Fa-f:\-])([0-9A-Fa-f]{3,4})(?![0-9A-Fa-f])"
CLOCK_TIME = r"(?<![0-9:])((?:[01]?\d|2[0-3]):[0-5]\d(?::[0-5]\d)?)(?![0-9:])"


def id_hints(c: Column | str) -> Column:
    """Identifiers in a text: prefixed ones first, then bare ones of 3 or 4 digits that are no year; distinct, in order."""
    s = F.regexp_replace(F.coalesce(_c(c), F.lit("")), rf"(?i)\S+\.(?:{FILE_TOKENS})", " ")
    s = F.regexp_replace(s, DATE_OR_TIME, " ")
    prefixed = F.regexp_extract_all(s, F.lit(PREFIXED_ID), 1)
    bare = F.regexp_extract_all(s, F.lit(BARE_ID), 1)
    bare = F.filter(bare, lambda x: ~(x.rlike("^[0-9]{4}$") & x.try_cast("int").between(1900, 2100)))
    return F.array_distinct(F.transform(F.concat(prefixed, bare), hex_id))


def time_hints(c: Column | str) -> Column:
    """Clock times HH:MM[:SS], hours padded; distinct, in order."""
    found = F.regexp_extract_all(F.coalesce(_c(c), F.lit("")), F.lit(CLOCK_TIME), 1)
    return F.array_distinct(F.transform(found, lambda t: F.when(t.rlike(r"^\d:"), F.concat(F.lit("0"), t)).otherwise(t)))


def summary_code(c: Column | str) -> Column:
    """`CODE_title` and `【CODE】title` to `[CODE]title`; anything else as it is."""
    c = _c(c)
    return F.when(c.rlike("^[A-Z0-9]{2,}_"), F.regexp_replace(c, "^([A-Z0-9]{2,})_", "[$1]")).otherwise(F.regexp_replace(c, "^【([^】]+)】", "[$1]"))


def html_escaped(c: Column | str) -> Column:
    out = _c(c)
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        out = F.replace(out, F.lit(raw), F.lit(safe))
    return out


def line_count(c: Column | str) -> Column:
    return F.length(_c(c)) - F.length(F.replace(_c(c), F.lit("\n"), F.lit(""))) + 1


def number_tuple(c: Column | str) -> Column:
    """`2.1.3` to [2, 1, 3]; arrays compare element by element. Null where it isn't one."""
    parts = F.transform(F.split(F.rtrim(F.trim(_c(c)), F.lit(".")), r"\."), lambda p: p.try_cast("int"))
    return F.when(F.forall(parts, lambda p: p.isNotNull()), parts)


def posix(c: Column | str) -> Column:
    return F.regexp_replace(F.replace(_c(c), F.lit("\\"), F.lit("/")), "^(\\./)+", "")


#: Letters that case folding changes and lower-casing doesn't.
FOLDED = {"ß": "ss", "ς": "σ", "ſ": "s"}


def casefolded(c: Column | str) -> Column:
    """A POSIX path for comparing whatever its case."""
    out = F.lower(posix(c))
    for letter, folded in FOLDED.items():
        out = F.replace(out, F.lit(letter), F.lit(folded))
    return out


def relative_to(c: Column | str, base: Column | str) -> Column:
    """A path from a directory, `..` for each step up; both are POSIX and from one root."""
    parts = lambda x: F.filter(F.split(posix(x), "/"), lambda p: (p != "") & (p != "."))
    a, b = parts(c), parts(base)
    shared = F.size(F.filter(F.sequence(F.lit(1), F.greatest(F.least(F.size(a), F.size(b)), F.lit(1))), lambda n: (n <= F.least(F.size(a), F.size(b))) & (F.slice(a, 1, n) == F.slice(b, 1, n))))
    steps = F.concat(F.array_repeat(F.lit(".."), F.size(b) - shared), F.slice(a, shared + 1, F.greatest(F.size(a), F.lit(1))))
    return F.when(F.size(steps) == 0, ".").otherwise(F.array_join(steps, "/"))


def blob_hash(c: Column | str) -> Column:
    """The version-control blob id of a text: SHA-1 over a typed length header and the content."""
    return F.sha1(F.concat(F.encode(F.concat(F.lit("blob "), F.octet_length(_c(c)).cast("string")), "UTF-8"), F.unhex(F.lit("00")), F.encode(_c(c), "UTF-8")))


def links(c: Column | str) -> Column:
    """Targets of Markdown links and images, the angle-bracket form included."""
    raw = F.regexp_extract_all(F.coalesce(_c(c), F.lit("")), F.lit(r"\]\((<[^>]*>|[^)\s]+)[^)]*\)"), 1)
    return F.transform(raw, lambda x: F.regexp_replace(x, "^<|>$", ""))


def local_paths(c: Column | str) -> Column:
    """Backticked tokens that look like paths of files."""
    raw = F.regexp_extract_all(F.coalesce(_c(c), F.lit("")), F.lit("`([^`\n]+)`"), 1)
    raw = F.transform(raw, lambda x: F.regexp_replace(F.trim(x), "[.,;:]+$", ""))
    good = F.filter(raw, lambda x: (x != "") & ~x.contains("://") & ~x.rlike('[*?<>| (){}"…=&→#]') & x.rlike(r"[/\\]") & ~x.contains("..") & ~x.rlike("^/[A-Za-z0-9._-]+$"))
    return F.transform(good, lambda x: F.replace(x, F.lit("\\"), F.lit("/")))


def receipt_fields(c: Column | str) -> Column:
    """`key: value` lines, either colon, to a map with lower-cased keys; the last of a key counts."""
    lines = F.filter(F.split(F.translate(F.coalesce(_c(c), F.lit("")), "：", ":"), "\n"), lambda x: x.rlike("^\\s*[^:]+:"))
    pairs = F.transform(lines, lambda x: F.struct(F.lower(F.trim(F.regexp_extract(x, "^([^:]+):", 1))).alias("k"), F.trim(F.regexp_extract(x, "^[^:]+:(.*)$", 1)).alias("v")))
    return F.aggregate(pairs, F.create_map().cast("map<string,string>"), lambda m, p: F.map_concat(F.map_filter(m, lambda k, _: k != p["k"]), F.create_map(p["k"], p["v"])))


#: Labels of a receipt's lines and the fields they stand for.
RECEIPT_LABELS = {"工程归属": "project", "复杂度": "size", "工作量": "size", "一句话结论": "conclusion", "待确认数": "pending", "报告": "report", "需人工注意": "attention", "KEY": "key"}
CONFIDENCE = "置信度"


def _labelled(labels: list[str]):
    return lambda p: p["k"].isin(labels)


def receipt_report(c: Column | str) -> Column:
    """A receipt's `label: value` lines, either colon, list marks aside, as fields; the last line of a field counts.

    The project's line may end in its confidence, after a slash; pending keeps its digits alone, 0 without any.
    """
    lines = F.transform(F.split(F.coalesce(_c(c), F.lit("")), "\r?\n"), lambda x: F.regexp_replace(x, "^([^:：]*)：", "$1:"))
    pairs = F.transform(F.filter(lines, lambda x: x.contains(":")), lambda x: F.struct(F.regexp_replace(F.trim(F.regexp_extract(x, "^([^:]*):", 1)), r"^[-* ]+", "").alias("k"), F.trim(F.regexp_extract(x, "^[^:]*:(.*)$", 1)).alias("v")))

    by_field = {f: [k for k, v in RECEIPT_LABELS.items() if v == f] for f in dict.fromkeys(RECEIPT_LABELS.values())}
    held = {f: F.try_element_at(F.transform(F.filter(pairs, _labelled(ls)), lambda p: p["v"]), F.lit(-1)) for f, ls in by_field.items()}
    rated = held["project"].contains("/") & held["project"].contains(CONFIDENCE)
    project = F.when(rated, F.regexp_replace(F.split_part(held["project"], F.lit(CONFIDENCE), F.lit(1)), r"[/\s]+$", "")).otherwise(held["project"])
    sure = F.when(rated, F.trim(F.regexp_extract(held["project"], f"{CONFIDENCE}(.*)$", 1), F.lit(" /")))
    digits = F.regexp_replace(held["pending"], "[^0-9]", "")
    pending = F.when(held["pending"].isNotNull(), F.coalesce(F.nullif(digits, F.lit("")).try_cast("long"), F.lit(0)))
    rest = [held[f].alias(f) for f in ("size", "conclusion", "report", "attention", "key")]
    return F.struct(project.alias("project"), sure.alias("confidence"), pending.alias("pending"), *rest)


def must_hold(c: Column | str, part: str) -> Column:
    """The text, or an error where it lacks the part."""
    c = _c(c)
    return F.when(F.coalesce(c.contains(part), F.lit(False)), c).otherwise(F.raise_error(F.lit(f"the text lacks {part!r}")).cast("string"))


def thousands(c: Column | str) -> Column:
    return F.format_number(_c(c), 0)


def percent(part: Column | str, whole: Column | str, digits: int = 1) -> Column:
    """`12.5%`; a dash where the whole is nothing."""
    return F.when(_c(whole) != 0, F.format_string(f"%.{digits}f%%", 100.0 * _c(part) / _c(whole))).otherwise("-")


def has_marker(content: Column | str, marker: str, first: int = 64) -> Column:
    """Whether a file's first bytes hold a marker. content: binary."""
    return F.coalesce(F.instr(F.decode(F.substring(_c(content), 1, first), "ISO-8859-1"), marker) > 0, F.lit(False))


def repaired_characters(c: Column | str) -> Column:
    """The radicals and private-use characters of a text, one array entry each."""
    return F.regexp_extract_all(F.coalesce(_c(c), F.lit("")), F.lit("[\u2e80-\u2fdf\ue000-\uf8ff]"), 0)


def error_message(c: Column | str, most: int = 300) -> Column:
    """The first message of a JSON error body, else its beginning."""
    c = _c(c)
    return F.coalesce(F.get_json_object(c, "$.errorMessages[0]"), F.get_json_object(c, "$.message"), F.substring(c, 1, most))


def display_name(*names: Column | str) -> Column:
    return F.coalesce(*[F.nullif(F.trim(_c(n)), F.lit("")) for n in names], F.lit("-"))


def browse_url(base: str, key: Column | str) -> Column:
    return F.concat(F.lit(base.rstrip("/") + "/browse/"), _c(key))


@lru_cache(maxsize=1)
def compatibility_table() -> tuple[str, str, str]:
    """(from, to, dropped) of the character map: one-character compatibility forms but the wide marks, radicals, symbols."""
    source, target, dropped = [], [], []
    for o in range(0x80, 0x30000):
        if 0xD800 <= o <= 0xDFFF:
            continue
        ch = chr(o)
        if o in PRIVATE_SYMBOLS:
            new = PRIVATE_SYMBOLS[o]
        elif 0xE000 <= o <= 0xF8FF:
            dropped.append(ch)
            continue
        else:
            new = unicodedata.normalize("NFKC", ch)
            if 0x2E80 <= o <= 0x2FDF and (len(new) != 1 or 0x2E80 <= ord(new) <= 0x2FDF):
                new = RADICALS.get(o, ch)
            elif ch in WIDE_MARKS:
                new = ch
        if len(new) == 1 and new != ch:
            source.append(ch)
            target.append(new)
    return "".join(source), "".join(target), "".join(dropped)


def normalised(c: Column | str) -> Column:
    """Compatibility forms repaired, wide punctuation kept; JVM-side by a generated character table."""
    source, target, _ = compatibility_table()
    return F.translate(F.regexp_replace(F.translate(_c(c), "".join(map(chr, PRIVATE_SYMBOLS)), "".join(PRIVATE_SYMBOLS.values())), "[\ue000-\uf8ff]", ""), source, target)


def repairs(c: Column | str) -> Column:
    """How many characters of a text are radicals or private-use ones."""
    return F.regexp_count(_c(c), F.lit("[\u2e80-\u2fdf\ue000-\uf8ff]"))
