"""Text keys as column expressions. Six rules that look alike and are not: none stands for another."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters whose case folding is ASCII but whose lower case is not.
_FOLDS = {"ß": "ss", "ẞ": "ss", "ſ": "s", "ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl", "ﬅ": "st", "ﬆ": "st"}


def casefold(text: Column) -> Column:
    """Lower case, with the few letters whose case folding ends in ASCII."""
    for letter, plain in _FOLDS.items():
        text = F.replace(text, F.lit(letter), F.lit(plain))
    return F.lower(text)


def words(text: Column) -> Column:
    """Runs of a-z and 0-9 in a text, as they stand."""
    return F.array_remove(F.split(text, "[^a-z0-9]+"), "")


def tokenize(text: Column) -> Column:
    """Search tokens: lower case, runs of a-z and 0-9 (an accent splits a word)."""
    return words(F.lower(text))


def _singular(word: Column) -> Column:
    n = F.char_length(word)
    cut = lambda k: F.substring(word, 1, n - k)
    return (
        F.when(word.endswith("ies") & (n > 4), F.concat(cut(3), F.lit("y")))
        .when(word.rlike("(ch|sh|ss|x|z)es$") & (n > 4), cut(2))
        .when(word.endswith("s") & ~word.endswith("ss") & (n > 3), cut(1))
        .otherwise(word)
    )


def entity_key(name: Column) -> Column:
    """Key of an entity's name: case-folded words, each in the singular."""
    return F.array_join(F.transform(words(casefold(name)), _singular), " ")


def structural_key(text: Column) -> Column:
    """Like an entity's key, without the singular."""
    return F.array_join(words(casefold(text)), " ")


def document_key(name: Column) -> Column:
    """Key of a document's name: case-folded runs of a-z and 0-9."""
    return F.array_join(words(casefold(name)), " ")


def type_key(name: Column) -> Column:
    """Key of a type's name: case-folded words joined by underscores."""
    return F.array_join(words(casefold(name)), "_")


def search_key(text: Column) -> Column:
    """Key under which search texts count as repeated: case-folded, runs of white space as one blank."""
    return F.trim(F.regexp_replace(casefold(text), r"(?U)\s+", " "))


def keep_first(values: Column, key: Callable[[Column], Column], seen: Column | None = None) -> Column:
    """The values of an array whose key is not empty and did not occur before, nor is ``seen``, in order."""
    keyed = F.transform(values, lambda x, i: F.struct(key(x).alias("key"), i.alias("at"), x.alias("value")))
    keyed = F.array_sort(F.filter(keyed, lambda p: p["key"] != ""))
    once = F.struct(keyed.alias("keyed"), (F.lit("") if seen is None else seen).alias("seen"))

    def chosen(s: Column) -> Column:
        # beside each value the key of the one before it in order of keys: sorted, not every value against all
        before = F.concat(F.array(s["seen"]), F.transform(s["keyed"], lambda p: p["key"]))
        pairs = F.zip_with(s["keyed"], before, lambda p, b: F.when((p["key"] != b) & (p["key"] != s["seen"]), F.struct(p["at"].alias("at"), p["value"].alias("value"))))
        return F.transform(F.array_sort(F.filter(pairs, lambda x: x.isNotNull())), lambda x: x["value"])

    return F.get(F.transform(F.array(once), chosen), F.lit(0))


def file_name(path: Column) -> Column:
    """Last component of a path."""
    return F.element_at(F.split(path, "/"), -1)


def stem(path: Column) -> Column:
    """File name without its last suffix; a leading dot begins no suffix."""
    return F.regexp_replace(file_name(path), r"(?<=.)\.[^.]*$", "")


def title(path: Column) -> Column:
    """A document's title: the stem with hyphens and underscores as blanks."""
    return F.trim(F.regexp_replace(stem(path), "[-_]+", " "))


def in_folder(source: Column, folder: str) -> Column:
    """Whether a path lies in a folder, by whole components; backslashes count as slashes."""
    path, folder = F.replace(source, F.lit("\\"), F.lit("/")), folder.replace("\\", "/").strip("/")
    return (path == folder) | path.startswith(f"{folder}/")


def content_hash(markdown: Column, version: str = "corvane-1") -> Column:
    """Identity of a document's content under one version of the processing."""
    return F.sha2(F.concat(F.lit(f"{version}\0"), markdown).cast("binary"), 256)


def source_key(source: Column) -> Column:
    """A short file-safe key of a source: slug of its stem and eight digits of a hash of its path."""
    slug = F.array_join(words(casefold(stem(source))), "-")
    path = F.replace(source, F.lit("\\"), F.lit("/"))
    return F.concat(F.when(slug == "", "source").otherwise(slug), F.lit("-"), F.substring(F.sha2(path.cast("binary"), 256), 1, 8))


def has_content(text: Column) -> Column:
    """Whether a text holds a letter or a digit of any script."""
    return text.rlike(r"[\p{L}\p{N}]")


def clock(milliseconds: Column) -> Column:
    """HH:MM:SS of a number of milliseconds."""
    s = F.floor(milliseconds / 1000)
    part = lambda x: F.lpad(x.cast("string"), 2, "0")
    hours = F.floor(s / 3600).cast("string")
    return F.concat_ws(":", F.when(F.char_length(hours) < 2, F.lpad(hours, 2, "0")).otherwise(hours), part(F.floor(s / 60) % 60), part(s % 60))
