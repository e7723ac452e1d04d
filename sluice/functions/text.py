"""String functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Openings that captioning models put before the caption, tried in this order: phrases first,
#: then every subject with every verb.
OPENING_PHRASES = ("In the video,", "In this video,", "In this video clip,", "In the clip,", "Caption:")
OPENING_SUBJECTS = ("This video", "The video", "This clip", "The clip", "The animation", "This image", "The image", "This picture", "The picture")
OPENING_VERBS = ("shows", "depicts", "features", "captures", "highlights", "introduces", "presents")
CAPTION_OPENINGS = (*OPENING_PHRASES, *(f"{s} {v}" for s in OPENING_SUBJECTS for v in OPENING_VERBS))


def path_list(s: Column) -> Column:
    """Items of a JSON array, or of a list delimited by ; or |; trimmed, without empty ones."""
    plain = F.split(F.replace(s, F.lit(";"), F.lit("|")), r"\|")
    items = F.when(F.ltrim(s).startswith("["), F.from_json(s, "array<string>")).otherwise(plain)
    return F.filter(F.transform(items, lambda x: F.trim(x)), lambda x: x != "")


def strip_opening(s: Column, openings: tuple[str, ...] = CAPTION_OPENINGS) -> Column:
    """Trim, drop the first opening that fits (one at most), trim again."""
    out = None
    text = F.trim(s)
    for o in openings:
        hit, rest = text.startswith(o), F.substr(text, F.lit(len(o) + 1))
        out = F.when(hit, rest) if out is None else out.when(hit, rest)
    return F.trim(out.otherwise(text))


def clean_typography(s: Column) -> Column:
    """Plain quotes, dashes and spaces; leading non-letters go unless nothing would be left."""
    plain = F.translate(s, "\u2018\u2019\u201c\u201d\u2014\u2013\u00a0\u2032\u2212", "''\"\"-- '-")
    bare = F.regexp_replace(plain, r"^[^\p{L}]+", "")
    return F.when(bare == "", plain).otherwise(bare)


def safe_id(s: Column) -> Column:
    """Null for ids with path parts or control characters; else cleaned of odd characters."""
    unsafe = s.rlike(r"[/\\\x00-\x1f\x7f]") | s.contains("..")
    return F.when(~unsafe, F.btrim(F.regexp_replace(s, "[^A-Za-z0-9._-]+", "_"), F.lit("._-")))


def safe_dir_name(s: Column, length: int = 40) -> Column:
    """A readable name with a digest that keeps different ids apart."""
    name = F.btrim(F.regexp_replace(s, "[^A-Za-z0-9._-]+", "_"), F.lit("._-"))
    return F.concat_ws("_", F.substring(name, 1, length), F.substring(F.sha2(s, 256), 1, 12))


def model_response(s: Column, key: str = "caption") -> Column:
    """What a model answered: thoughts are removed, then a JSON value, embedded JSON, cut-off
    JSON, or the text itself."""
    shown = F.regexp_replace(s, r"(?s)<think>.*?</think>", "")
    shown = F.trim(F.when(shown.contains("</think>"), F.substring_index(shown, "</think>", -1)).otherwise(shown))
    embedded = F.regexp_extract(shown, r"(?s)(\{.*\})", 1)
    cut = F.regexp_extract(shown, rf'(?s)"{key}"\s*:\s*"((?:[^"\\]|\\.)*)', 1)
    nonempty = lambda c: F.when(c != "", c)
    return F.coalesce(F.get_json_object(shown, f"$.{key}"), F.get_json_object(nonempty(embedded), f"$.{key}"), nonempty(cut), shown)


def is_absolute(s: Column) -> Column:
    """POSIX or Windows absolute paths."""
    return s.rlike(r"^(/|[A-Za-z]:[\\/]|\\\\)")


def resolve_path(root: str, s: Column) -> Column:
    return F.when(is_absolute(s), s).otherwise(F.concat_ws("/", F.lit(root.rstrip("/")), s))


def clock(seconds: Column) -> Column:
    """HH:MM:SS of whole seconds."""
    s = seconds.cast("long")
    return F.format_string("%02d:%02d:%02d", F.floor(s / 3600), F.floor(s % 3600 / 60), s % 60)


def with_trigger(trigger: str, s: Column) -> Column:
    return F.concat(F.lit(f"{trigger.strip()} "), s)


def words(s: Column) -> Column:
    return F.regexp_count(s, F.lit(r"\S+"))


def prompt(task: Column, leads: dict[str, str], other: str, s: Column) -> Column:
    """A text behind the lead of its task."""
    lead = F.element_at(F.create_map(*[F.lit(x) for pair in leads.items() for x in pair]), task)
    return F.concat(F.coalesce(lead, F.lit(other)), s)


def buckets(s: Column) -> Column:
    """WxHxF;WxHxF;... as an array of (w, h, f)."""
    one = lambda b: F.struct(*[F.get(F.split(b, "x"), i).cast("int").alias(n) for i, n in enumerate("whf")])
    return F.transform(F.filter(F.split(s, ";"), lambda b: F.trim(b) != ""), one)


def stem(path: Column) -> Column:
    """A path's last part without its suffix."""
    return F.regexp_replace(F.substring_index(path, "/", -1), r"\.[^.]*$", "")


def comma_list(s: Column) -> Column:
    return F.filter(F.transform(F.split(s, ","), lambda x: F.trim(x)), lambda x: x != "")


def merge_maps(left: Column, right: Column) -> Column:
    """Keys of both maps; the right one's values win."""
    kept = F.map_filter(left, lambda k, v: ~F.map_contains_key(right, k))
    return F.map_concat(kept, right)


def output_path(path: Column, root: str, out: str, suffix: str) -> Column:
    """Where an input's output goes: below ``out`` as the input lies below ``root``, or by its whole path."""
    inside = path.startswith(root.rstrip("/") + "/")
    rel = F.when(inside, F.substr(path, F.lit(len(root.rstrip("/")) + 2))).otherwise(F.ltrim(path, F.lit("/")))
    return F.concat(F.lit(out.rstrip("/") + "/"), F.regexp_replace(rel, r"\.[^./]*$", ""), F.lit(suffix))


#: All characters that count as white space.
WHITE = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def stripped(s: Column) -> Column:
    """Without white space of any kind at both ends. Only the ends are looked at: a pattern would be tried at every character."""
    return F.btrim(s, F.lit(WHITE))


def stem_of_name(name: Column) -> Column:
    """A file name without its last suffix; a leading or trailing dot makes no suffix."""
    return F.regexp_replace(name, r"(?s)^(.+)\.[^.]+\z", "$1")


def output_id(s: Column) -> Column:
    """An id as a file name: runs of other characters become one underscore, dots, dashes and underscores go at both ends."""
    return F.btrim(F.regexp_replace(stripped(s), "[^A-Za-z0-9._-]+", "_"), F.lit("._-"))


def output_id_problem(s: Column) -> Column:
    """Why an id cannot name an output; null if it can."""
    bare = stripped(s)
    unsafe = bare.rlike(r"[/\\]") | bare.contains("..")
    return F.when(bare == "", "empty_id").when(unsafe, "unsafe_id").when(bare.rlike(r"[\x00-\x1f\x7f]"), "control_character_in_id").when(output_id(s) == "", "no_safe_name")


def normal_path(s: Column) -> Column:
    """An absolute path without empty parts, ``.`` and ``..`` (links are not followed)."""
    parts = F.filter(F.split(s, "/"), lambda x: (x != "") & (x != "."))
    up = lambda done, x: F.when(x == "..", F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))).otherwise(F.concat(done, F.array(x)))
    return F.concat(F.lit("/"), F.array_join(F.aggregate(parts, F.array().cast("array<string>"), up), "/"))


def sample_dir(task: Column, key: Column, length: int = 72) -> Column:
    """A sample's folder name: its task, the start of its key, and a digest of the whole key."""
    plain = lambda c, other: F.coalesce(F.nullif(F.btrim(F.regexp_replace(c, "[^A-Za-z0-9_-]+", "_"), F.lit("_")), F.lit("")), F.lit(other))
    return F.concat_ws("_", plain(task, "task"), F.substring(plain(key, "sample"), 1, length), F.substring(F.sha2(key, 256), 1, 12))
