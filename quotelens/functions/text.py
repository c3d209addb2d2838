"""Text functions as Column expressions, and plain-Python twins for the alignment kernel.

Everything here stays inside the JVM; the few rules that need state (inflection splits) exist in
Python only, where the kernel uses them.
"""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values of the data model: letters and marks that normalisation treats alike -----------
ARABIC_MARKS = "[\u0610-\u061a\u064b-\u065f\u0670\u06d6-\u06ed\u0640]"
ARABIC_SAME = {"ی": "ي", "ک": "ك", "إ": "ا", "أ": "ا", "آ": "ا", "ٱ": "ا", "ى": "ي", "ة": "ه"}
KEYBOARD_SAME = {"ی": "ي", "ے": "ي", "ک": "ك", "ہ": "ه", "ھ": "ه", "ۀ": "ه", "ۃ": "ه", "ە": "ه"}
SOUND_SAME = {"ص": "س", "ث": "س", "ض": "د", "ظ": "ز", "ذ": "ز", "ط": "ت", "ق": "ك", "ح": "ه", "ع": "ا", "ء": "ا", "ئ": "ا", "ؤ": "و", "غ": "ك", "خ": "ه"}
ARTICLE_PREFIXES = ["وال", "بال", "كال", "فال", "لل", "ال"]
ARABIC_SUFFIXES = ["هما", "كما", "هم", "هن", "كم", "نا", "ها", "ون", "ين", "ان", "ات", "وا", "يه", "ه", "ك", "ي", "ت", "ا"]
# ---------------------------------------------------------------------------------------------------


def _accents() -> tuple[str, str, dict[str, str]]:
    """Characters whose Unicode decomposition is one ASCII letter or digit, those letters, and the
    ligatures and digraphs of Latin letters with the letters that they stand for."""
    source, base, several = [], [], {}
    for code in range(0x80, 0x10000):
        if 0xD800 <= code < 0xE000:
            continue
        flat = unicodedata.normalize("NFKD", chr(code).lower())
        letters = [c for c in flat if not unicodedata.combining(c)]
        plain = all(c.isascii() and c.isalnum() for c in letters)
        if plain and len(letters) == 1:
            source.append(chr(code))
            base.append(letters[0])
        elif plain and letters and (code < 0x250 or 0xFB00 <= code <= 0xFB06):
            several[chr(code)] = "".join(letters)
    return "".join(source), "".join(base), several


_ACCENTED, _PLAIN, _SEVERAL = _accents()
_TABLE = str.maketrans(dict(zip(_ACCENTED, _PLAIN)) | _SEVERAL)


def _translate(col: Column, same: dict[str, str]) -> Column:
    return F.translate(col, "".join(same), "".join(same.values()))


def norm_en(col: Column) -> Column:
    """Lower-case ASCII letters and digits, single spaces; marks on Latin letters are dropped."""
    flat = F.translate(F.lower(F.coalesce(col, F.lit(""))), _ACCENTED, _PLAIN)
    wide = flat
    for one, letters in _SEVERAL.items():
        wide = F.replace(wide, F.lit(one), F.lit(letters))
    flat = F.when(flat.rlike("[" + "".join(_SEVERAL) + "]"), wide).otherwise(flat)
    flat = F.regexp_replace(flat, "[\u0300-\u036f]", "")
    return F.trim(F.regexp_replace(flat, "[^a-z0-9]+", " "))


def norm_ar(col: Column) -> Column:
    """Arabic letters only: marks dropped, letter variants unified, single spaces."""
    flat = _translate(F.regexp_replace(_translate(F.coalesce(col, F.lit("")), {"ی": "ي", "ک": "ك"}), ARABIC_MARKS, ""), ARABIC_SAME)
    return F.trim(F.regexp_replace(F.regexp_replace(flat, "[^ء-ي ]", " "), r"\s+", " "))


def digits_ascii(col: Column) -> Column:
    """Eastern Arabic digits of both kinds as ASCII digits."""
    east = "".join(chr(0x660 + i) for i in range(10)) + "".join(chr(0x6F0 + i) for i in range(10))
    return F.translate(col, east, "0123456789" * 2)


def norm_mixed(col: Column) -> Column:
    """Either script: Arabic rules where an Arabic letter occurs, else the Latin ones."""
    flat = digits_ascii(_translate(F.coalesce(col, F.lit("")), KEYBOARD_SAME))
    return F.when(flat.rlike("[ء-ي]"), norm_ar(flat)).otherwise(norm_en(flat))


def is_latin(col: Column) -> Column:
    return F.coalesce(col.rlike("^[a-z0-9]"), F.lit(False))


def fold(col: Column) -> Column:
    """Letters that speech recognition confuses become one."""
    return _translate(col, SOUND_SAME)


def words(col: Column) -> Column:
    """Array of the words of a normalised text; none for an empty text."""
    return F.filter(F.split(col, " "), lambda w: w != "")


def stem_en(w: Column) -> Column:
    """Light suffix rules: ies, sses, then one of ing / ed / ly / s, then a final e."""
    n = F.length(w)
    cut = lambda k: F.substring(w, F.lit(1), n - k)
    plural = w.endswith("s") & ~w.endswith("ss") & ~w.endswith("us")
    once = (
        F.when((n > 5) & w.endswith("ing"), cut(3))
        .when((n > 4) & w.endswith("ed"), cut(2))
        .when((n > 5) & w.endswith("ly"), cut(2))
        .when((n > 3) & plural, cut(1))
        .otherwise(w)
    )
    bare = F.when((F.length(once) > 3) & once.endswith("e"), F.substring(once, F.lit(1), F.length(once) - 1)).otherwise(once)
    return F.when((n > 4) & w.endswith("ies"), F.concat(cut(3), F.lit("y"))).when((n > 5) & w.endswith("sses"), cut(2)).otherwise(bare)


def stem_ar(w: Column) -> Column:
    """Light affix rules for a folded Arabic word: article, one particle, a suffix, a verb prefix."""

    def drop_first(x: Column, prefixes, otherwise: Column) -> Column:
        out = otherwise
        for p in reversed(prefixes):
            out = F.when(x.startswith(p) & (F.length(x) - len(p) >= 3), F.substring(x, F.lit(len(p) + 1), F.length(x))).otherwise(out)
        return out

    rest = F.substring(w, F.lit(2), F.length(w))
    head = F.substring(w, 1, 1)
    second = F.when(
        (F.length(rest) >= 5) & F.substring(rest, 1, 1).isin("ل", "ب") & ~rest.startswith("ال"), F.substring(rest, F.lit(2), F.length(rest))
    ).otherwise(rest)
    after = F.when(head.isin("و", "ف"), drop_first(rest, ["بال", "كال", "لل"], second)).otherwise(rest)
    after = F.when(after.startswith("ال") & (F.length(after) >= 5), F.substring(after, F.lit(3), F.length(after))).otherwise(after)
    particle = F.when((F.length(w) >= 5) & head.isin("و", "ف", "ب", "ل"), after).otherwise(w)
    s = drop_first(w, ARTICLE_PREFIXES, particle)
    out = s
    for x in reversed(ARABIC_SUFFIXES):
        out = F.when(s.endswith(x) & (F.length(s) - len(x) >= 3), F.substring(s, F.lit(1), F.length(s) - len(x))).otherwise(out)
    return F.when((F.length(out) >= 4) & F.substring(out, 1, 1).isin("ي", "ت", "ن"), F.substring(out, F.lit(2), F.length(out))).otherwise(out)


def stem(w: Column) -> Column:
    return F.when(is_latin(w), stem_en(w)).otherwise(stem_ar(w))


def within(a: Column, b: Column, most: int) -> Column:
    """Whether at most `most` edits lead from a to b; the search stops beyond them."""
    return F.levenshtein(a, b, most) >= 0


def edit_distance(a: Column, b: Column, most: int = 3) -> Column:
    """Edits from a to b, or most + 1 when there are more."""
    d = F.levenshtein(a, b, most)
    return F.when(d < 0, most + 1).otherwise(d)


def word_sim(spoken: Column, source: Column, is_word: Column | None = None) -> Column:
    """exact, asr (alike once folded), near (one edit, two in long words) or diff; a spoken form that
    is a word of the corpus is never excused as mis-heard."""
    fa, fb = fold(spoken), fold(source)
    m = F.least(F.length(fa), F.length(fb))
    near = F.when(m >= 8, within(fa, fb, 2)).otherwise((m >= 4) & within(fa, fb, 1))
    soft = F.when(fa == fb, "asr").when(near, "near").otherwise("diff")
    if is_word is not None:
        soft = F.when(F.coalesce(is_word, F.lit(False)), "diff").otherwise(soft)
    return F.when(spoken == source, "exact").otherwise(soft)


def grade_class(col: Column, weak: str = r"(?i)weak|da.?if|fabricated|rejected", strong: str = r"(?i)sahih|hasan|authentic|sound|good") -> Column:
    """weak, strong or neutral by the words of a grading; weak wins."""
    return F.when(col.rlike(weak), "weak").when(col.rlike(strong), "strong").otherwise("neutral")


def windows(n: Column, whole: int = 140, size: int = 120, step: int = 100) -> Column:
    """Array of (a, b): one window up to `whole` words, else windows of `size` every `step`, the last
    one ending where the text ends."""
    last = n - size
    starts = F.array_distinct(F.concat(F.sequence(F.lit(0), last, F.lit(step)), F.array(last)))
    many = F.transform(starts, lambda a: F.struct(a.cast("int").alias("a"), (a + size).cast("int").alias("b")))
    return F.when(n <= whole, F.array(F.struct(F.lit(0).alias("a"), n.cast("int").alias("b")))).otherwise(many)


def clock(seconds: Column) -> Column:
    """m:ss, or h:mm:ss from an hour on; empty for null."""
    s = F.floor(F.greatest(seconds, F.lit(0)))
    h, m, r = F.floor(s / 3600), F.floor(s % 3600 / 60), s % 60
    pad = lambda x: F.lpad(x.cast("string"), 2, "0")
    long = F.concat_ws(":", h.cast("string"), pad(m), pad(r))
    return F.when(seconds.isNull(), "").when(h > 0, long).otherwise(F.concat_ws(":", m.cast("string"), pad(r)))


def srt_clock(seconds: Column) -> Column:
    """hh:mm:ss,mmm."""
    ms = F.round(F.greatest(seconds, F.lit(0)) * 1000).cast("long")
    pad = lambda x, n: F.lpad(x.cast("string"), n, "0")
    return F.concat(
        pad(F.floor(ms / 3600000), 2), F.lit(":"), pad(F.floor(ms % 3600000 / 60000), 2), F.lit(":"), pad(F.floor(ms % 60000 / 1000), 2), F.lit(","), pad(ms % 1000, 3)
    )


def csv_guard(col: Column) -> Column:
    """A cell that a spreadsheet would read as a formula gets a leading apostrophe."""
    return F.when(col.rlike(r"^[=+\-@\t\r]"), F.concat(F.lit("'"), col)).otherwise(col)


def video_id(url: Column) -> Column:
    """The 11-character id in a video address or alone; empty if there is none."""
    found = F.regexp_extract(url, r"(?:youtu\.be/|[?&]v=|/(?:embed|shorts|live|v)/)([A-Za-z0-9_-]{11})(?![A-Za-z0-9_-])", 1)
    return F.when(found != "", found).when(url.rlike(r"^[A-Za-z0-9_-]{11}$"), url).otherwise("")


def sentence_end(col: Column) -> Column:
    return F.coalesce(col.rlike(r"[.!?…؟۔][\"'»”’)\]]*$"), F.lit(False))


def excerpt(tokens: Column, at: Column, before: int = 4, after: int = 5) -> Column:
    """Words around a 0-based place, with ellipses where something is left out."""
    lo = F.greatest(at - before, F.lit(0))
    hi = F.least(at + after + 1, F.size(tokens))
    text = F.array_join(F.slice(tokens, lo + 1, hi - lo), " ")
    return F.concat(F.when(lo > 0, "… ").otherwise(""), text, F.when(hi < F.size(tokens), " …").otherwise(""))


# --- plain Python, for the kernel --------------------------------------------------------------------

_SPACES = re.compile("[^a-z0-9]+")
_FOLD = str.maketrans(SOUND_SAME)


def py_norm_en(text: str | None) -> str:
    flat = (text or "").lower().translate(_TABLE)
    return _SPACES.sub(" ", "".join(c for c in flat if not "\u0300" <= c <= "\u036f")).strip()


def py_fold(w: str) -> str:
    return w if w.isascii() else w.translate(_FOLD)


def py_within(a: str, b: str, most: int) -> bool:
    """At most `most` edits between a and b, by a diagonal band."""
    if abs(len(a) - len(b)) > most:
        return False
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        left, diagonal = i, row[0]
        row[0] = i
        low = i
        for j in range(1, len(b) + 1):
            best = min(row[j] + 1, left + 1, diagonal + (x != b[j - 1]))
            diagonal, row[j], left = row[j], best, best
            low = min(low, best)
        if low > most:
            return False
    return row[-1] <= most


def py_near(fa: str, fb: str) -> bool:
    m = min(len(fa), len(fb))
    return py_within(fa, fb, 2) if m >= 8 else m >= 4 and py_within(fa, fb, 1)


def py_word_sim(a: str, b: str, is_word=None) -> str:
    if a == b:
        return "exact"
    fa, fb = py_fold(a), py_fold(b)
    kind = "asr" if fa == fb else ("near" if py_near(fa, fb) else "diff")
    return "diff" if kind != "diff" and is_word is not None and is_word(a) else kind
