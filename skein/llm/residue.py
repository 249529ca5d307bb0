"""Template residue, filler and error pages among texts.

Texts fall into units (lines and sentences) outside code and quotation. A unit
that holds a slot mark, a default value or a blank is a suspect: the rest of it
is a template with those places open. The template is aligned with the units of
all records that begin or end like it; a place that other records fill, with
values that differ, is an induced slot, and the suspect shows it unfilled. Whole
pages and filler are aligned likewise: a page or unit that looks like one by its
wording is settled by its template being met in several records.

What is certain without alignment (a mark that only templating uses, the very
wording of an error page) comes out even where no other record shares the
template; ``explain`` tells the two apart.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.llm import wording as W
from skein.llm.wording import fold
from skein.runtime import Stage

_FEW = 100_000  # templates that are sent to all tasks
_ANCHORS = (12, 5, 2)  # characters of a unit's beginning or end by which it is found
_SPAN = 3  # tokens that fill a slot
_CONTEXT = 3  # words around the slots of a template that words may fill
FILL, GAP, TAIL = "\x02", "\x05", "\x06"  # a masked token, an open place, and any rest
PLAIN, VALUE, MARK, DEFAULT = range(4)


# --- units ---------------------------------------------------------------------


def mask(text: str) -> str:
    """The text with code, quotations and slot marks as tokens: \\x02 letter content \\x03."""
    text = W._IGNORED.sub("", text)
    if "```" in text or "~~~" in text:
        text = W._FENCE.sub("\n", text)
    if "`" in text:
        text = W._INLINE.sub(" \x02c\x03 ", text)
    if "{" in text:
        text = W._JSON_ERROR.sub("\x02e\x03", text)
    if _MAY_MARK.search(text):
        text = W.SLOT.sub(lambda m: f"\x02m{m[0]}\x03", text)
        text = W.WEAK_SLOT.sub(lambda m: m[0] if "\x02" in m[0] else f"\x02w{m[0]}\x03", text)
    return W._QUOTED.sub(_quotation, text) if _MAY_QUOTE.search(text) else text


def _quotation(m) -> str:
    return " \x02q\x03 "


_MAY_MARK = re.compile(r"[{\[<$#%*@_]")
_MAY_QUOTE = re.compile("[\"“„«「]")
_DEFAULT = re.compile(r"(?<![\w/.])(?:n/a|null|undefined|none|nil|nan|tba|xxx|default)(?![\w/])", re.IGNORECASE)


class Unit:
    """A line or sentence; what wording makes of it is worked out where it may matter."""

    __slots__ = ("text", "code", "hits", "folded", "named", "chrome", "stutter")

    def __init__(self, raw: str):
        self.text = raw.strip()
        self.code = "\x02c" in raw or "->" in raw or bool(W._CODE_LINE.match(raw))
        if self.code and "<noscript" not in raw.lower():
            self.hits, self.folded = 0, ""  # tells of code, whatever else
        else:
            plain = W._HTML_TAG.sub(_tag, self.text) if "<" in self.text else self.text
            self.folded = fold(plain)
            self.hits = W.bits(self.folded)
        self.named, self.chrome, self.stutter = False, None, False

    def weigh(self) -> None:
        """Code-like tokens out of the wording, page furniture told."""
        if self.chrome is not None or not self.folded:
            self.chrome = bool(self.chrome)
            return
        plain = W._HTML_TAG.sub(_tag, self.text) if "<" in self.text else self.text
        names = [t for t in W._TOKEN.findall(self.text) if t[0] != "\x02" and W._word(t)[1] and W._word(t)[0] not in W._DEFAULTS]
        for token in sorted(names, key=len, reverse=True):
            plain = plain.replace(token, token.replace("/", " ") if W._EITHER.fullmatch(token) else W._NAME)
        self.named = any(not W._EITHER.fullmatch(t) and not W._ADDRESS.match(t) and any(c.isalpha() for c in t) for t in names)
        if names:
            self.folded = fold(plain)
        self.chrome = any(c.isalpha() or c == "©" for c in self.folded) and bool(W._CHROME.match(self.folded))

    def key(self) -> str:
        """The unit as a template: every code-like or changing token masked, names of hosts too."""
        return " ".join(FILL if "." in t[1:-1] else t for t, _, _, _ in tokens(self.text))


def _tag(m) -> str:
    return "<noscript>" if "noscript" in m[0].lower() else " "


def tokens(text: str) -> list[tuple[str, int, int, str]]:
    """(shape, status, start, raw) of each token; the shape of all but plain words is a mask."""
    out = []
    for m in W._TOKEN.finditer(text):
        raw = m[0]
        if raw[0] == "\x02":
            out.append((FILL, MARK if raw[1] in "mw" else VALUE, m.start(), raw[2:-1]))
            continue
        word, _, value = W._word(raw)
        if word in W._DEFAULTS:
            out.append((FILL, DEFAULT, m.start(), raw))
        else:
            out.append((FILL, VALUE, m.start(), raw) if value else (word, PLAIN, m.start(), raw))
    return out


def _is_filler(unit: Unit) -> bool:
    if not unit.folded:
        return False
    words = unit.folded.split()
    n = len(words)
    if n < 9:
        words = [w.strip(".,;:!?") for w in words]
    # A word three times over, few words in all, or made of filler's syllables.
    few = n > 2 and (different := len(set(words))) < n and 2 * different <= n + 6
    latin = n > 4 and (W.is_latin(words[0]) or W.is_latin(words[1]))
    if not (few or latin or unit.hits & W.FILLER):
        return False
    unit.weigh()
    if few and any(a == b == c and len(a) > 3 and a.isalpha() for a, b, c in zip(words, words[1:], words[2:])):
        return True
    return (W._opens_as_filler if unit.named else W._is_filler)(W._plain(unit.folded))


def _filler_key(unit: Unit) -> str:
    """What of a filler other records may share: the phrase it holds, else the words it repeats, else its kind."""
    if (said := W._FILLER.search(unit.folded)) is not None:
        return said[0]
    words = list(dict.fromkeys(w.strip(".,;:!?") for w in unit.folded.split()))
    return " ".join(words[:6]) if len(words) <= 6 else "latin"


def _page_kind(unit: Unit) -> int:
    """0 other text, 1 words that may belong to an error page, 2 an error or notice, 3 page furniture."""
    if not unit.folded or not (unit.hits & W.PAGE or len(unit.folded) < 60 or unit.text[0] == "<"):
        return 0
    unit.weigh()
    if unit.chrome:
        return 3 if not W._ERROR.search(unit.folded) else 2
    markup = unit.text[:5].lower() in ("<html", "<!doc")
    if not (unit.hits & W.PAGE or markup or unit.folded.strip(" .!:").isdigit()):
        return 0
    return W._wording(W._plain(unit.folded), markup)


def _page_key(units: list[Unit], kinds: list[int]) -> str:
    return str(W._hash("\n".join(u.key() for u, k in zip(units, kinds) if k != 3)))


# --- suspects --------------------------------------------------------------------


def template(unit: Unit) -> tuple[str, list[set[str]], list[str]] | None:
    """(template, forms of each open place, anchors) of a unit with open places.

    Segments of tokens joined by GAP. Anchors are what the unit begins or ends
    with before its first and after its last open or masked place. None where
    nothing is open, or nothing is left to align by.
    """
    text = unit.text
    found = tokens(text)
    gaps: list[tuple[int, int, str]] = []
    for i, (_, status, at, _) in enumerate(found):
        if status == MARK:
            gaps.append((i, i + 1, "mark" if text[at + 1] == "m" else "weak"))
        elif status == DEFAULT:
            gaps.append((i, i + 1, "default"))
    if not unit.code:
        for m in W._BLANK.finditer(text):
            i = sum(t[2] <= m.start() for t in found)
            gaps.append((i, i, "blank"))
    if not gaps:
        return None
    gaps.sort()
    segments: list[list[str]] = [[]]
    places: list[set[str]] = []
    at = 0
    for i, j, form in gaps:
        between = [t[0] for t in found[at:i]]
        if places and not between:
            places[-1].add(form)
        else:
            segments[-1].extend(between)
            places.append({form})
            segments.append([])
        at = max(at, j)
    segments[-1].extend(t[0] for t in found[at:])
    if not any(segments):
        return None
    firm = next((t[2] for t in found if t[1] != PLAIN), len(text))
    firm = min([firm, *(m.start() + 1 for m in W._BLANK.finditer(text))]) if not unit.code else firm
    loose = max((t[2] + len(t[3]) + 3 for t in found if t[1] in (MARK, VALUE)), default=0)
    loose = max([loose, *(t[2] + len(t[3]) for t in found if t[1] == DEFAULT), *(m.end() - 1 for m in W._BLANK.finditer(text))])
    anchors = []
    for n in _ANCHORS:
        if firm >= n:
            anchors.append(f"h{n}:{text[:n]}")
        elif len(text) - loose >= n:
            anchors.append(f"t{n}:{text[-n:]}")
        else:
            continue
        break
    return GAP.join(" ".join(s) for s in segments), places, anchors


def prefixes(unit: Unit) -> Iterator[tuple[str, list[str]]]:
    """Templates of the unit's beginning up to each weak mark, whatever follows."""
    found = tokens(unit.text)
    for i, (_, status, at, _) in enumerate(found):
        if i and status == MARK and unit.text[at + 1] == "w":
            shape = " ".join(t[0] for t in found[:i])
            firm = next((t[2] for t in found if t[1] != PLAIN), 0)
            anchors = [f"h{n}:{unit.text[:n]}" for n in _ANCHORS if firm >= n][:1]
            yield f"{shape}{GAP}{TAIL}", anchors


def fills(template: str, found: list[tuple[str, int, int, str]]) -> list[tuple[int, int]] | None:
    """The token spans that fill a template's places in a unit, each of at most _SPAN tokens; None if it does not fit."""
    segments, shape = _parsed(template), [t[0] for t in found]
    n = len(shape)
    if shape[: len(segments[0])] != segments[0]:
        return None
    if segments[-1] == [TAIL]:
        at = len(segments[0])
        return [(at, at + 1)] if at < n and found[at][1] == MARK else None
    if sum(map(len, segments)) > n or segments[-1] and shape[n - len(segments[-1]) :] != segments[-1]:
        return None

    def place(k: int, at: int) -> list[tuple[int, int]] | None:
        last = k == len(segments) - 1
        for size in [n - len(segments[-1]) - at] if last else range(_SPAN + 1):
            end = at + size
            if 0 <= size <= _SPAN and shape[end : end + len(segments[k])] == segments[k]:
                rest = [] if last else place(k + 1, end + len(segments[k]))
                if rest is not None:
                    return [(at, end), *rest]
        return None

    return place(1, len(segments[0]))


@lru_cache(1 << 14)
def _parsed(template: str) -> list[list[str]]:
    return [s.split(" ") if s else [] for s in template.split(GAP)]


@lru_cache(1 << 14)
def _words(template: str) -> int:
    return sum(t.isalpha() for s in _parsed(template) for t in s)


# --- one text ------------------------------------------------------------------------


def inspect(text: str, first_words: int = 400) -> tuple[bool, list[tuple], list[Unit]]:
    """(certain, doubts, units) of one text.

    Doubts are (form, key, place, anchors): forms mark, weak, default and blank
    with a template, filler and page with the hash of one; ``certain`` if a
    mark, filler or the wording of a page is one without alignment.
    ``first_words``: characters of other text that may precede such a page; an
    error further down, or before more text, is a doubt that has to repeat.
    """
    masked = mask(text)
    units = [Unit(raw) for raw in W._SPLIT.split(masked) if raw and not raw.isspace()]
    doubts: list[tuple] = []
    certain = False
    for unit in units:
        body = unit.text
        if "\x02m" in body:
            certain = True
        blank = "  " in body or "\t" in body or body[-1:] == ":" or " ." in body or " ," in body
        blank = blank and not unit.code and W._BLANK.search(body) is not None
        default = (unit.hits if unit.folded else W.bits(body.lower())) & W.DEFAULT and _DEFAULT.search(body)
        if "\x02m" in body or "\x02w" in body or blank or default:
            if (made := template(unit)) is not None:
                key, places, anchors = made
                for i, forms in enumerate(places):
                    doubts.extend((form, key, i, anchors) for form in forms)
        if "\x02w" in body:
            doubts.extend(("weak", key, 0, anchors) for key, anchors in prefixes(unit))
        if not unit.code and _is_filler(unit):
            certain = True
            doubts.append(("filler", _filler_key(unit), -1, []))
    page, pages = _pages(units, first_words)
    return certain or page, doubts + [("page", key, -1, []) for key in pages], units


def _pages(units: list[Unit], first_words: int) -> tuple[bool, set[str]]:
    """Whether a page is certain, and the keys of what may be one; of a certain page also those of its error units."""
    keys: set[str] = set()
    kinds = None
    # Units without a literal that wording needs are other text, unless some unit beside them is not.
    if any(u.hits & W.PAGE and _page_kind(u) or u.text[:5].lower() in ("<html", "<!doc") for u in units):
        kinds = [_page_kind(u) for u in units]
        certain, before = False, 0
        for i, (unit, kind) in enumerate(zip(units, kinds)):
            if kind:
                later = kinds[i:]
                rest = sum(len(u.text) for u, k in zip(units[i:], later) if k == 0)
                if before <= first_words and rest <= max(80, before):
                    certain = 2 in later or not rest and (later.count(1) > 1 or 1 in later and 3 in later)
                    if certain or 3 in later and rest or not before and not rest and 1 in later:
                        keys.add(_page_key(units[i:], later))
                break
            before += len(unit.text)
        keys |= {_page_key(units[i:], kinds[i:]) for i, kind in enumerate(kinds) if kind == 2}
        if certain:
            return True, keys | {"unit " + u.key() for u, k in zip(units, kinds) if k in (1, 2)}
    return False, keys | set(_like_pages(units, kinds, first_words))


def _like_pages(units: list[Unit], kinds: list[int] | None, first_words: int) -> Iterator[str]:
    """Keys of the whole text and of tails after its first words that look like a page of any wording."""
    before = 0
    starts = []
    for i, unit in enumerate(units):
        if before > first_words:
            break
        rest = units[i:]
        if len(rest) <= W._PAGE_UNITS and sum(len(u.text) for u in rest) <= W._PAGE_CHARS:
            starts.append(i)
        before += len(unit.text)
    if not starts:
        return
    # All signs together must be there before units are looked at one by one.
    if not W.may_be_page(" \n ".join(u.folded for u in units[starts[0] :])):
        return
    cues = []
    for i, unit in enumerate(units):
        if i < starts[0]:
            cues.append(0)
            continue
        unit.weigh()
        cues.append(W._cues(W._plain(unit.folded)) if unit.folded and not unit.named else 0)
    kinds = kinds or [_page_kind(u) for u in units]
    for i in starts:
        rest = units[i:]
        if cues[i]:
            said = [(len(u.text), c) for u, c, k in zip(rest, cues[i:], kinds[i:]) if k != 3]
            joint = 0
            for _, c in said:
                joint |= c
            # Something failed or a status, and two more signs; most of the text takes part.
            if said and joint & 5 and joint.bit_count() >= 3 and 2 * sum(n for n, c in said if c) > sum(n for n, _ in said):
                yield _page_key(rest, kinds[i:])


# --- all texts -------------------------------------------------------------------------

_SCAN = pa.schema(
    [("kind", pa.string()), ("doc_id", pa.int64()), ("form", pa.string()), ("key", pa.string()), ("place", pa.int32()), ("anchors", pa.list_(pa.string())), ("certain", pa.bool_())]
)
_SCAN_DDL = "kind string, doc_id bigint, form string, key string, place int, anchors array<string>, certain boolean"


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Doubts of documents, and the units that others are aligned with."""
    for batch in batches:
        rows: list[list] = [[] for _ in _SCAN]

        def put(*row) -> None:
            for column, value in zip(rows, row):
                column.append(value)

        for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
            if not text or text.isspace():
                continue
            certain, doubts, units = inspect(text)
            if certain:
                put("case", doc_id, None, None, None, None, True)
            for form, key, place, anchors in doubts:
                put("doubt", doc_id, form, key, place, anchors, certain)
            said = [u.text for u in units if len(u.text) > 2]
            n = len(said)
            for column, values in zip(rows, (["unit"] * n, [doc_id] * n, [None] * n, said, [None] * n, [None] * n, [None] * n)):
                column.extend(values)
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(rows, _SCAN)], schema=_SCAN)


@lru_cache(1 << 14)
def _probe(template: str) -> str:
    """The longest word of a template, which a unit that fits must hold."""
    return max((t for s in _parsed(template) for t in s if t.isalpha()), key=len, default="")


_FILLS_DDL = "key string, place int, filled string, value bigint, lo bigint, hi bigint"


def _filled(text: str, templates, lo: int, hi: int) -> Iterator[tuple]:
    folded = fold(text)
    templates = [k for k in templates if _probe(k) in folded]
    found = tokens(text) if templates else []
    for key in templates:
        spans = fills(key, found)
        for place, (i, j) in enumerate(spans or ()):
            part = found[i:j]
            if not part:
                continue
            if any(t[1] in (MARK, DEFAULT) for t in part):
                how = "mark"
            elif all(t[1] == VALUE for t in part):
                how = "value"
            elif _words(key) >= _CONTEXT and all(t[1] == VALUE or t[0][0].isalnum() for t in (part[0], part[-1])):
                how = "word"
            else:
                continue
            yield key, place, how, W._value(" ".join(t[3] if t[1] else t[0] for t in part)), lo, hi


def _aligner(by_anchor: dict[str, list[str]]):
    def align(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for text, lo, hi in zip(batch["key"], batch["lo"], batch["hi"]):
                near = [k for a in _anchors_of(text.lower()) for k in by_anchor.get(a, ())]
                rows.extend(_filled(text, near, lo, hi))
            yield pd.DataFrame(rows, columns=["key", "place", "filled", "value", "lo", "hi"])

    return align


def _anchors_of(text: str) -> list[str]:
    return [x for n in _ANCHORS if len(text) >= n for x in (f"h{n}:{text[:n]}", f"t{n}:{text[-n:]}")]


def _align_pairs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = [x for text, key, lo, hi in zip(batch["key"], batch["template"], batch["lo"], batch["hi"]) for x in _filled(text, [key], lo, hi)]
        yield pd.DataFrame(rows, columns=["key", "place", "filled", "value", "lo", "hi"])


def explain(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, reason, aligned) of texts that hold residue, filler or an error page.

    reason: mark, weak, default and blank for slots left unfilled, filler, page;
    ``aligned`` tells that other records share the template and fill the place,
    or show the same page or filler. Reasons 'alone' are certain by wording
    only. Null, empty and blank texts are no case. Ids must be integers;
    repeated ids are judged text by text. One map over the texts writes doubts
    and units out; only units that begin or end like a doubtful template are
    shuffled, each distinct one once. Such a template is not found by its
    beginning or end where both are slots: its marks then count alone.
    """
    spark = df.sparkSession
    texts = df.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    stage = Stage(spark, "residue")
    found = stage.put(texts.mapInArrow(_scan, _SCAN_DDL), "scan", partition_by="kind")
    doubts = found.where("kind = 'doubt'").select("doc_id", "form", "key", "place", "certain")
    # Pages and filler that several records show.
    shown = doubts.where("place = -1").groupBy("form", "key").agg(F.countDistinct(F.coalesce("doc_id", F.lit(-1))).alias("n")).where("n > 1").select("form", "key")
    whole = doubts.join(shown, ["form", "key"], "left_semi").select("doc_id", "form")
    # Templates with open places against the units that begin or end like them.
    wanted = found.where("kind = 'doubt' AND place >= 0").select("key", F.explode("anchors").alias("anchor")).select("key", F.lower("anchor").alias("anchor")).distinct()
    # The longest word of a template; a plain text without it needs no look.
    words = F.transform(F.filter(F.split("key", f"[ {GAP}{TAIL}]"), lambda w: w.rlike("^[a-z]+$")), lambda w: F.struct(F.length(w).alias("n"), w.alias("w")))
    wanted = stage.put(wanted.withColumn("probe", F.coalesce(F.try_element_at(F.array_sort(words), F.lit(-1))["w"], F.lit(""))), "templates")
    low = F.lower("key")
    ends = F.flatten(F.array(*[F.array(F.concat(F.lit(f"h{n}:"), F.substring(low, 1, n)), F.concat(F.lit(f"t{n}:"), F.right(low, F.lit(n)))) for n in _ANCHORS]))
    near = found.where("kind = 'unit'").select("key", "doc_id", F.explode(ends).alias("anchor"))
    held = wanted.limit(_FEW + 1).toPandas()
    if len(held) <= _FEW:
        by_anchor = {a: sorted(g) for a, g in held.groupby("anchor")["key"]}
        probes = F.broadcast(wanted.select(F.col("anchor").alias("wanted"), "probe").distinct())
        holds = (F.octet_length("key") != F.length("key")) | F.contains(low, F.col("probe"))
        near = near.join(probes, (F.col("anchor") == F.col("wanted")) & holds, "left_semi")
        units = near.groupBy("key").agg(F.min(F.coalesce("doc_id", F.lit(-1))).alias("lo"), F.max(F.coalesce("doc_id", F.lit(-1))).alias("hi"))
        filled = units.mapInPandas(_aligner(by_anchor), _FILLS_DDL)
    else:
        units = near.groupBy("key", "anchor").agg(F.min(F.coalesce("doc_id", F.lit(-1))).alias("lo"), F.max(F.coalesce("doc_id", F.lit(-1))).alias("hi"))
        pairs = units.join(wanted.select(F.col("key").alias("template"), "anchor"), "anchor").select("key", "template", "lo", "hi")
        filled = pairs.mapInPandas(_align_pairs, _FILLS_DDL)
    real = F.col("filled") != "mark"
    proven = (
        filled.groupBy("key", "place")
        .agg(
            F.min(F.when(real, F.col("value"))).alias("a"), F.max(F.when(real, F.col("value"))).alias("b"),
            F.min(F.when(real, F.col("lo"))).alias("lo"), F.max(F.when(real, F.col("hi"))).alias("hi"),
            F.count_if(F.col("filled") == "value").alias("n_values"),
            F.min(F.when(~real, F.col("value"))).alias("c"), F.max(F.when(~real, F.col("value"))).alias("d"),
        )
        .select("key", "place", F.coalesce((F.col("a") < F.col("b")) & (F.col("lo") < F.col("hi")), F.lit(False)).alias("differ"), ((F.col("n_values") > 0) | F.coalesce(F.col("c") < F.col("d"), F.lit(False))).alias("seen"))
    )
    slots = doubts.where("place >= 0").join(proven, ["key", "place"]).where("differ OR seen AND form IN ('mark', 'weak', 'default')").select("doc_id", "form")
    aligned = whole.unionByName(slots).distinct()
    cases = found.where("kind = 'case'").select("doc_id").distinct()
    alone = cases.join(aligned.select(F.col("doc_id").alias("other")).distinct(), F.col("doc_id").eqNullSafe(F.col("other")), "left_anti")
    return aligned.select("doc_id", F.col("form").alias("reason"), F.lit(True).alias("aligned")).unionByName(alone.select("doc_id", F.lit("alone").alias("reason"), F.lit(False).alias("aligned")))


def residue(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Ids of texts that hold residue, filler or an error page, one row each; see ``explain``."""
    return explain(df, id_col, text_col).select("doc_id").distinct()
