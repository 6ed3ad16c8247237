"""Statistics of texts that tell running prose from lists, tables, code, diffs and junk.

Two kinds of statistics come out for each text, both over the whole text. Those of published filters (words, mean word length,
symbols, bullets, ellipses, lines ending in punctuation, common words, letters, repeated lines), each held against its published fixed
threshold with a reason for every failure. And the share of non-blank characters in running sentences, which those
filters don't have: the lines of many texts at once are sorted into headers, list entries, table rows, code, diff lines and
others by their shape; the others are joined to paragraphs, and a paragraph runs if its words hold to the same kind of thresholds (common
words of its language, length of words, letters) and are as many as a sentence needs.

All of it is computed column by column, on Arrow arrays of the words and lines of many texts; a distinct word is looked at once.

Words are what stands between blanks (of ASCII), lines what stands between line ends; blank lines don't count. Null and empty texts have
zero statistics and the reason ``no_text``; copies have equal results. Columns of the input that aren't kept don't matter.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Frequent function words.
COMMON_WORDS = {
    "en": "the be to of and that have with a an in is are was were it this for on as at by from or but not we you they i he she his her its our their which who what when if then than so can could would will should has had been do does did no there here into only more about after before because while until how all any some one also just now still never out up over again most them us me my your these those where too very since without although though between both each few other such same own being having may might must let what's it's don't",
    "de": "der die das und ist nicht ein eine einen einem einer eines zu den dem des mit auf für von im in es er sie wir ich ihr sich auch als an aus bei nach noch nur oder aber wenn weil dass daß wie war waren wird werden wurde hat haben hatte sind kann können muss soll so bis vor über unter um durch ohne gegen zwischen sehr mehr schon jetzt immer wieder dann da hier man kein keine keinen dieser diese dieses diesem jede jeder ob bisher deshalb sonst",
    "fr": "le la les un une des et est ne pas que qui de du d l à au aux en dans sur pour par avec sans ce cet cette ces il elle ils elles on nous vous je tu se sa son ses leur leurs mais ou où donc si comme plus moins très bien était étaient être avoir a ont avait sont sera fait tout tous encore après avant quand parce toujours jamais aussi cela ça rien y dont lors même",
    "es": "el la los las un una unos unas y e es no que de del al a en con por para sin sobre se su sus lo le les me mi nos ha han había era eran ser está están fue pero o si como más menos muy ya cuando porque qué este esta esto estos estas ese esa eso entre hasta desde también solo sólo todo todos nada nadie antes después otra otro vez hay donde mucho cada",
    "it": "il lo la gli le un una e è non che di del della dei delle al alla in nel nella con per su da si ci ma o se come più anche questo questa sono era essere ha hanno dopo prima quando perché ancora molto",
    "pt": "o a os as um uma e é não que de do da dos das em no na nos nas com por para se seu sua mas ou como mais também este esta isso são era ser foi tem depois antes quando porque ainda muito já",
    "nl": "de het een en is niet dat die van in op te met voor aan door er om maar of als bij naar ook nog wel zijn was waren wordt worden heeft hebben had kan zo dan dit deze geen meer hier wat wij we ze zij je ik hij over uit tot na voordat omdat",
}
_COMMON = {w: [w in words.split() for words in COMMON_WORDS.values()] for w in sorted({w for words in COMMON_WORDS.values() for w in words.split()})}

# Thresholds of published filters for web text (Gopher, C4 and FineWeb).
RULES = (
    ("too_few_words", "n_words", 50, None),
    ("too_many_words", "n_words", None, 100_000),
    ("short_words", "mean_word_length", 3, None),
    ("long_words", "mean_word_length", None, 10),
    ("symbols", "symbol_ratio", None, 0.1),
    ("bullets", "bullet_lines", None, 0.9),
    ("ellipses", "ellipsis_lines", None, 0.3),
    ("few_letters", "letter_words", 0.8, None),
    ("few_common_words", "n_common", 2, None),
    ("unpunctuated_lines", "punctuated_lines", 0.12, None),
    ("repeated_lines", "repeated_lines", None, 0.3),
    ("not_running_prose", "prose_share", 0.5, None),
)

# The words of the published rule on common words, ends of sentences, marks of list entries.
STOP_WORDS = ("the", "be", "to", "of", "and", "that", "have", "with")
ENDS = (".", "!", "?", '"', "'", "”", "»")
BULLETS = ("-", "*", "+", "•", "‣", "◦", "·")

#: A paragraph runs if it has at least so many words, and of them at least this share are common in one language.
SENTENCE_WORDS = 6
COMMON_SHARE = 0.22

BLANKS = " \t\n\r\f\v"
#: Lines of at most so many bytes, or one text, are sorted together.
CHUNK = 8 << 20


# Shapes of lines, in the syntax of RE2. W: a letter, digit or underscore of any script.
_W = r"[\p{L}\p{N}_]"
HEAD = r"^(?:commit [0-9a-f]{7,64}\b|(?:Merge|Author|AuthorDate|Commit|CommitDate|Committer|Date|From|Subject|To|Cc|Message-Id|In-Reply-To|References|X-[\w-]+|MIME-Version|Content-[\w-]+): |From [0-9a-f]{40} )"
TRAILER = r"^(?:[A-Z][A-Za-z]*(?:-[A-Za-z]+)+: \S|(?:Fixes|Closes|Refs?|See|Link|Bug|Issue|Reverts|Resolves|Version|URL|url|artifacts): ?\S)"
LIST = r"^(?:[-*+•‣◦·–—]|\[[ xX]\]|\(?(?:\d{1,3}|[a-zA-Z]|[ivx]{1,4})[.)])(?:\s|$)"
DIFF_START = r"^(?:diff --|Index: |--- \S|@@ -\d|GIT binary patch|index [0-9a-f]{7,}\.\.)"
DIFF_LINE = r"^(?:[-+ @\\]|$|diff --|index [0-9a-f]|(?:new|deleted|old) (?:file )?mode|(?:similarity|dissimilarity) index|(?:rename|copy) (?:from|to) |Binary files |GIT binary patch|(?:literal|delta) \d|[A-Za-z][!-~]{20,}$|z[!-~]*$)"
TABLE = r"\|.*\||;.*;.*;|\t\S|\S {3,}\S|^[^ ,]+,[^ ,]+,[^ ,]|,.*,\""
CODE = rf"[{{}};\\]$|[=<>!+]=|=>|->|::|&&|\|\||{_W}\.{_W}+\(|</?{_W}+>|{_W}\[{_W}+\]|^(?:#include|#define|import |from {_W}+ import|def |class |return |SELECT |INSERT |ALTER |CREATE |//|/\*|\*/|--|#)|{_W}\([^\s(]*\)\s*[;:{{]?$|{_W}_{_W}.*[=:]"
RULER = r"^[^\p{L}\p{N}]+$"
LOG = rf"^(?:\[?\d{{4}}-\d\d-\d\d|\d\d:\d\d:\d\d|\[[\p{{L}}\p{{N}}_ ]+\] |[0-9a-f]{{7,64}}\b|(?:ERROR|WARN|INFO|DEBUG|TRACE)\b|{_W}+Error:|\s*at {_W}|https?://|<{{7}}|>{{7}}|={{7}})"
SHAPES = "|".join(f"(?:{x})" for x in (HEAD, TRAILER, LOG, TABLE, CODE, RULER))
LINE_END = "\r\n|[\n\r\v\f\x1c-\x1e\x85\u2028\u2029]"
_WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*")
WITHIN = r"[.!?] [A-ZÀ-Ý]"


def _is(lines: pa.Array, shape: str) -> np.ndarray:
    return pc.match_substring_regex(lines, shape).to_numpy(zero_copy_only=False).astype(bool)


def _numbers(a: pa.Array) -> np.ndarray:
    return a.to_numpy(zero_copy_only=False).astype(np.int64)


def _last(mark: np.ndarray) -> np.ndarray:
    """The last marked place up to each place, itself included; -1 if there is none."""
    return np.maximum.accumulate(np.where(mark, np.arange(len(mark)), -1)) if len(mark) else np.zeros(0, np.int64)


def _before(last: np.ndarray) -> np.ndarray:
    return np.concatenate([[-1], last[:-1]]) if len(last) else last


def _prose_lines(raw: pa.Array, begin: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """Which lines may be prose, and all lines without outer blanks and marks of quotes. begin: the first line of each line's text."""
    line = pc.utf8_trim_whitespace(raw)
    indent = _numbers(pc.utf8_length(pc.utf8_rtrim_whitespace(raw))) - _numbers(pc.utf8_length(line))
    quote = pc.and_(pc.starts_with(line, ">"), pc.invert(pc.starts_with(line, ">>>>>>>")))
    if pc.any(quote).as_py():
        line = pc.replace_with_mask(line, quote, pc.utf8_trim_whitespace(pc.replace_substring_regex(line.filter(quote), r"^(?:>\s?)+", "")))
    here = _numbers(pc.binary_length(line)) > 0
    # A diff goes on from a line that starts one to the next line that is none of a diff.
    starts = here & (indent == 0) & _is(line, DIFF_START)
    ends = _is(raw, HEAD) | ~_is(raw, DIFF_LINE)
    since = _before(_last(starts))
    in_diff = (since >= begin) & (_last(ends) <= since)
    at = np.flatnonzero(here & ~in_diff & ~starts)
    # The other shapes are asked of what is left only. A list entry goes on in lines that are indented deeper.
    rest, listed = line.take(pa.array(at)), np.zeros(len(raw), bool)
    listed[at] = _is(rest, LIST)
    entry = _last(listed)
    plain = np.zeros(len(raw), bool)
    plain[at] = ~listed[at]
    known = entry >= begin
    broken = _last(plain & ~(known & (indent > indent[np.maximum(entry, 0)])))
    goes_on = plain & known & (broken < entry)
    out = np.zeros(len(raw), bool)
    at = np.flatnonzero(plain & ~goes_on)
    out[at] = ~_is(line.take(pa.array(at)), SHAPES)
    return out, line


def _sums(values: np.ndarray, group: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(group, weights=values, minlength=n)


def prose_chars(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Non-blank characters of each text in running sentences, and in all. No text is null."""
    every = _numbers(pc.utf8_length(texts)) - sum(_numbers(pc.count_substring(texts, b)) for b in BLANKS)
    odd = pc.match_substring_regex(texts, "[\r\v\f\x1c-\x1e\x85\u2028\u2029]")
    if pc.any(odd).as_py():
        texts = pc.replace_with_mask(texts, odd, pc.replace_substring_regex(texts.filter(odd), LINE_END, "\n"))
    split = pc.split_pattern(texts, "\n")
    of, raw = _numbers(pc.list_parent_indices(split)), split.flatten()
    first = np.searchsorted(of, np.arange(len(texts)))
    prose, line = _prose_lines(raw, first[of])
    at = np.flatnonzero(prose)
    if not len(at):
        return np.zeros(len(texts)), every
    line, of = line.take(pa.array(at)), of[at]
    words = _words(line)
    # A paragraph is a run of such lines.
    new = np.concatenate([[True], (at[1:] != at[:-1] + 1) | (of[1:] != of[:-1])])
    para = np.cumsum(new) - 1
    n = int(para[-1]) + 1
    lines, ends = _sums(np.ones(len(at)), para, n), _sums(_is(line, "[.!?…:]$"), para, n)
    # Each line ends by itself, or none does: a line has to be a sentence alone. Wrapped text has ends within lines.
    alone = (lines > 1) & ((ends >= 0.8 * lines) & (ends > 0) | (ends == 0) & (_sums(_is(line, WITHIN), para, n) == 0) & (_sums(words.tokens < SENTENCE_WORDS, para, n) == 0))
    part = np.cumsum(new | alone[para]) - 1
    runs = _running(words, part, int(part[-1]) + 1)
    return _sums(np.where(runs[part], words.size, 0), of, len(texts)), every


@dataclass
class _Words:
    """The words of some lines: line and word of each, the words, and of each line its tokens between blanks and their characters."""

    line: np.ndarray
    word: np.ndarray
    known: list[str]
    tokens: np.ndarray
    size: np.ndarray


def _words(lines: pa.Array) -> _Words:
    """Each distinct token is looked at once."""
    split = pc.ascii_split_whitespace(pc.utf8_lower(lines))
    line, coded = _numbers(pc.list_parent_indices(split)), split.flatten().dictionary_encode()
    token, distinct = _numbers(coded.indices), coded.dictionary.to_pylist()
    known: dict[str, int] = {}
    inside = [[known.setdefault(w, len(known)) for w in _WORD.findall(t)] for t in distinct]
    parts = [t.split() for t in distinct]  # at other blanks, too
    count = lambda values: _sums(np.array(values, dtype=np.int64)[token], line, len(lines)) if distinct else np.zeros(len(lines))
    many = np.array([len(x) for x in inside], dtype=np.int64)
    each, begin = many[token], np.cumsum(many) - many
    at = np.repeat(begin[token] - (np.cumsum(each) - each), each) + np.arange(each.sum())
    return _Words(np.repeat(line, each), np.array([w for x in inside for w in x], dtype=np.int64)[at], list(known), count([len(p) for p in parts]), count([sum(map(len, p)) for p in parts]))


def _running(words: _Words, part: np.ndarray, n: int) -> np.ndarray:
    """Which parts (groups of lines) are running sentences."""
    group, word, known = part[words.line], words.word, words.known
    tokens = _sums(words.tokens, part, n)
    letters = _sums(np.array([len(w) for w in known] or [0])[word], group, n)
    common = np.array([_COMMON.get(w, [False] * len(COMMON_WORDS)) for w in known], dtype=bool).reshape(-1, len(COMMON_WORDS))
    most = np.max([_sums(common[word, k], group, n) for k in range(len(COMMON_WORDS))], axis=0)
    words = _sums(np.ones(len(word)), group, n)
    pairs = np.sort(group * max(1, len(known)) + word)
    different = np.bincount(pairs[np.diff(pairs, prepend=-1) > 0] // max(1, len(known)), minlength=n)
    mean = letters / np.maximum(words, 1)
    enough = (words >= SENTENCE_WORDS) & (words >= 0.7 * tokens) & (most >= 2) & (most >= COMMON_SHARE * words)
    return enough & (mean >= 2.5) & (mean <= 10) & (different >= np.minimum(5, 0.5 * words))


def statistics(texts: pa.Array) -> dict[str, np.ndarray]:
    """All statistics of texts, none null, by name."""
    n = len(texts)
    inside, every = prose_chars(texts)
    split = pc.ascii_split_whitespace(texts)
    doc, coded = _numbers(pc.list_parent_indices(split)), split.flatten().dictionary_encode()
    word = _numbers(coded.indices)
    of_words = lambda values: _sums(np.asarray(values, dtype=np.float64)[word], doc, n) if len(word) else np.zeros(n)
    words = of_words(_numbers(pc.binary_length(coded.dictionary)) > 0)
    runs = pc.split_pattern_regex(pc.utf8_lower(coded.dictionary), r"[^\p{L}]+")
    token, run = _numbers(pc.list_parent_indices(runs)), runs.flatten()
    of_runs = lambda mark: np.bincount(token, weights=mark, minlength=len(coded.dictionary))
    is_ = lambda values: pc.is_in(run, pa.array(values, pa.string())).to_numpy(zero_copy_only=False)
    bare = of_words(of_runs(_numbers(pc.binary_length(run)) > 0))

    whole = pc.replace_substring(texts, "\r", "\n")
    split = pc.split_pattern(whole, "\n")
    lines = pc.ascii_trim(split.flatten(), BLANKS)
    here = pc.not_equal(lines, "")
    of, lines = _numbers(pc.list_parent_indices(split))[here.to_numpy(zero_copy_only=False)], lines.filter(here)
    of_lines = lambda mark: _sums(mark, of, n)
    line = _numbers(lines.dictionary_encode().indices)
    pairs = np.sort(of * (len(line) + 1) + line)
    distinct = np.bincount(pairs[np.diff(pairs, prepend=-1) > 0] // (len(line) + 1), minlength=n)
    m = np.bincount(of, minlength=n)
    count = lambda what: _numbers(pc.count_substring(texts, what))
    one, per_line = np.maximum(words, 1), np.maximum(m, 1)
    return {
        "n_words": words.astype(np.int64),
        "mean_word_length": every / one,
        "symbol_ratio": (count("#") + count("...") + count("…")) / one,
        "bullet_lines": of_lines(_is(lines, "^[" + "".join(BULLETS) + "]")) / per_line,
        "ellipsis_lines": of_lines(_is(lines, r"(?:\.\.\.|…)$")) / per_line,
        "punctuated_lines": of_lines(_is(lines, "[" + "".join(ENDS) + "]$")) / per_line,
        "letter_words": of_words(_is(coded.dictionary, r"\p{L}")) / one,
        "n_common": sum((of_words(of_runs(is_([w]))) > 0).astype(np.int64) for w in STOP_WORDS),
        "common_share": of_words(of_runs(is_(list(_COMMON)))) / np.maximum(bare, 1),
        "repeated_lines": (m - distinct) / per_line,
        "prose_share": inside / np.maximum(every, 1),
    }


FIELDS = list(statistics(pa.array([], pa.string())))


def quality(df: DataFrame, text: str, keep: list[str], rules: tuple = RULES) -> DataFrame:
    """(keep..., statistics..., reasons array<string>) of every text; no reason: it passes all rules."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pc.fill_null(batch.column(len(keep)), "")
            size, at = np.cumsum(_numbers(pc.binary_length(texts))), 0
            while at < len(texts):
                to = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + CHUNK, "right")))
                found = statistics(texts.slice(at, to - at))
                yield pa.RecordBatch.from_arrays([*[batch.column(k).slice(at, to - at) for k in range(len(keep))], *map(pa.array, found.values())], names=[*keep, *found])
                at = to

    kept = df.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text}`").cast("string").alias("__text"))
    fields = ", ".join([f"`{c}` {t}" for c, t in kept.drop("__text").dtypes] + [f"{f} {'long' if f in ('n_words', 'n_common') else 'double'}" for f in FIELDS])
    return kept.mapInArrow(read, fields).withColumn("reasons", reasons(rules))


def reasons(rules: tuple = RULES, empty: bool = True) -> F.Column:
    """Names of the rules that a row of statistics breaks. A share that must be exceeded (prose) fails at its threshold."""
    found = []
    for name, field, least, most in rules:
        c = F.col(field)
        low = (c <= least if name == "not_running_prose" else c < least) if least is not None else F.lit(False)
        high = c > most if most is not None else F.lit(False)
        found.append(F.when(low | high, F.lit(name)))
    first = [F.when(F.col("n_words") == 0, F.lit("no_text"))] if empty else []
    return F.array_compact(F.array(*first, *found))
