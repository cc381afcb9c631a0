"""Main text of web pages by two-pass block rules.

The first pass classifies each block by its length, its share of stop words and its share of linked characters as
good, bad, near good or short.  In the second, near-good and short blocks inherit from the nearest decided blocks:
of two that differ the nearer wins, and at equal distance bad does; a near-good block without any decided neighbour
is good, a short one is bad.  A heading takes the label of the next block that is no heading, if that is good.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SHORT, LONG = 70, 200
LOW_STOPWORDS, HIGH_STOPWORDS = 0.15, 0.25
MAX_LINK_DENSITY = 0.3

STOPWORDS = {
    "en": "the be to of and a in that have i it for not on with he as you do at this but his by from they we say her she or an will my one all would there their what so up out if about who get which go me is are was were has had been its our your can into than then them these some could only over also after when how",
    "fr": "le la les de des du un une et est en que qui dans pour pas sur par au aux avec ce il elle on ne se plus son sa ses ou mais comme nous vous ils elles être avoir cette ces leur à été sont était ont fait tout même si bien sans",
    "de": "der die das und in den von zu mit ist nicht ein eine im für auf dem des sich auch es an als er sie so aus bei nach wie über oder aber wir ihr ich war hat sind wird werden einer einem einen zum zur noch nur vor durch man um kann haben dass",
    "it": "il lo la i gli le un una di a da in con su per tra fra e che non si è sono del della dei delle al alla nel nella come più ma anche se questo questa ha hanno era essere ci cui loro suo sua o dal dalla",
    "pt": "o a os as um uma de do da dos das em no na nos nas por para com que e não se é são mais como mas foi ao aos à ou seu sua ele ela também já quando muito há ser está pelo pela até isso",
    "nl": "de het een van en in is dat op te zijn voor met die niet aan er om ook als bij maar door uit naar over dan nog of was ze hij zij heeft hebben wordt werd dit tot wel geen meer kan",
    "sv": "och att det i en är som på av för med den till inte om ett har han var de jag sig men så hon från vi kan ska där efter eller man hade när också vid bli mot under över",
    "pl": "w i na z do się nie że to jest o jak po co ale za od przez dla czy tak są oraz już tylko był jego jej ich który która które może przy być lub pod także",
    "ru": "и в не на я что он с как а это по но они мы она так его за от все о у же из был к до при или для если бы когда её их только было может чтобы под",
    "es": "el la los las de y en que un una es por con para no se su del al lo como más pero sus le ya o este sí porque esta entre cuando muy sin sobre también me hasta hay donde quien desde todo nos durante todos uno les ni contra otros ese eso ante ellos fue son ha era",
}
_STOP = {k: frozenset(v.split()) for k, v in STOPWORDS.items()}
_ALL = frozenset().union(*_STOP.values())

#: A tag without quotes; any other is scanned by `_Scanner.tag_end`.
_SIMPLE = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9]*)([^<>\"']*)>")
_OPENING = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9]*)")
_STOPPER = re.compile(r"[<>\"']")
_LANG = re.compile(r"\blang\s*=\s*[\"']?([a-zA-Z]+)", re.I)
#: A number that no character has, and that may have too many digits to read.
_HUGE = re.compile(r"&#(?:[0-9]{8,}|[xX][0-9a-fA-F]{8,});?")
#: Elements whose content is no text.  Where the end tag is missing the first kind, as the standard has it, goes on
#: to the end of the page; of the second only the tag goes.
_RAW = frozenset(("script", "style", "textarea"))
_LOOSE = frozenset(("noscript", "template", "svg", "select"))
_ENDS = {name: re.compile(rf"</{name}(?=[\s/>]|\Z)", re.I) for name in (*_RAW, *_LOOSE)} | {"title": re.compile(r"</(?:title|head)(?=[\s/>]|\Z)|<body(?=[\s/>]|\Z)", re.I)}
#: What can stand in a head, which goes on as far as there is nothing else; its tags may be missing.
_IN_HEAD = frozenset("html head title base basefont bgsound link meta script style noscript template".split())
_SPACE = re.compile(r"\s+")
_TOKEN = re.compile(r"\w+")
_BLOCK = frozenset("address article aside blockquote body br caption center col colgroup dd details dialog dir div dl dt fieldset figcaption figure footer form frame frameset h1 h2 h3 h4 h5 h6 header hr html li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead title tr ul".split())
_HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))


class _Scanner:
    """Places in a page; whatever is looked for is remembered, so that a page is searched once however it is broken."""

    def __init__(self, page: str) -> None:
        self.page = page
        self.known: dict[object, tuple[int, int]] = {}

    def next(self, what: str | re.Pattern, at: int) -> tuple[int, int]:
        """(start, end) of the next occurrence from ``at``, which never goes back; the page's length twice if there is none."""
        found = self.known.get(what)
        if found is None or found[0] < at:
            if isinstance(what, str):
                i = self.page.find(what, at)
                found = (i, i + len(what)) if i >= 0 else (len(self.page), len(self.page))
            else:
                m = what.search(self.page, at)
                found = m.span() if m else (len(self.page), len(self.page))
            self.known[what] = found
        return found

    def tag_end(self, at: int) -> int:
        """End of the tag whose name ends at ``at``: its ``>`` outside quoted values, or else the next ``<`` or the page's end."""
        page = self.page
        while m := _STOPPER.search(page, at):
            if m[0] == ">":
                return m.end()
            if m[0] == "<":
                return m.start()
            at = m.end()
            if page[max(0, m.start() - 16) : m.start()].rstrip().endswith("="):
                close, after = self.next(m[0], at)
                at = after if close < len(page) else at
        return len(page)


def blocks(page: str) -> tuple[list[tuple[str, int, bool]], str]:
    """((text, linked characters, is a heading) of each block with text, in order; the language the page states).

    Broken markup is taken as it stands, in time linear in the page: a tag that isn't closed ends at the next one.
    """
    out: list[tuple[str, int, bool]] = []
    parts: list[str] = []
    linked, in_link, heading, at, in_head, lang = 0, 0, False, 0, True, ""
    scan, size = _Scanner(page), len(page)

    def add(text: str) -> None:
        nonlocal linked
        if text:
            if "&" in text:
                text = html.unescape(_HUGE.sub("\ufffd", text))
            parts.append(text)
            if in_link:
                linked += len(_SPACE.sub(" ", text).strip())

    def close() -> None:
        nonlocal linked
        if parts:
            text = _SPACE.sub(" ", "".join(parts)).strip()
            if text:
                out.append((text, linked, heading))
            parts.clear()
        linked = 0

    while at < size:
        start = page.find("<", at)
        start = size if start < 0 else start
        if start > at:
            text = page[at:start]
            in_head = in_head and not text.strip()
            add(text)
        if start == size:
            break
        m = _SIMPLE.match(page, start)
        if m:
            at = m.end()
        elif m := _OPENING.match(page, start):
            at = scan.tag_end(m.end())
        elif page.startswith("<!--", start):
            at = scan.next("-->", start + 2)[1]
            continue
        elif page.startswith(("<!", "<?", "</"), start):
            stop, after = scan.next(">", start)
            at = after if stop < size else start + 2
            continue
        else:
            add("<")
            in_head = False
            at = start + 1
            continue
        closing, name = m[1], m[2].lower()
        if name == "html" and not closing and not lang:
            found = _LANG.search(page[m.end(2) : at])
            lang = found[1].lower() if found else ""
        if name in _RAW or name in _LOOSE:
            if not closing:
                stop, after = scan.next(_ENDS[name], at)
                if stop < size:
                    at = scan.tag_end(after)
                elif name in _RAW:
                    at = size
            parts.append(" ")
            continue
        if in_head:
            if name == "title" and not closing:
                stop, after = scan.next(_ENDS[name], at)
                # without an end tag of its own a title is the text before the next tag
                at = scan.tag_end(after) if page[stop : stop + 7].lower() == "</title" else scan.next("<", at)[0]
            if name in _IN_HEAD:
                in_head = not (closing and name == "head")
                continue
            in_head = False
        if name == "a":
            in_link = max(0, in_link - 1) if closing else in_link + 1
        elif name in _BLOCK:
            close()
            if name in _HEADINGS:
                heading = not closing
            elif name != "br":
                heading = False
            if not closing and name != "br":
                in_link = 0  # an anchor that was never closed doesn't reach into the next block
    close()
    return out, lang


def first_pass(text: str, linked: int, stop: frozenset[str] | None) -> str:
    """The label of a block; without a list of stop words its length and links alone decide."""
    density = linked / len(text)
    if density > MAX_LINK_DENSITY:
        return "bad"
    if len(text) < SHORT:
        return "bad" if density > 0 else "short"
    if stop is None:
        return "good" if len(text) > LONG else "near"
    tokens = _TOKEN.findall(text.lower())
    share = sum(map(stop.__contains__, tokens)) / max(1, len(tokens))
    if share < LOW_STOPWORDS:
        return "bad"
    return "good" if share >= HIGH_STOPWORDS or len(text) > LONG else "near"


def second_pass(labels: list[str], headings: list[bool]) -> list[bool]:
    """Whether each block is good."""
    n = len(labels)
    decided = [x in ("good", "bad") for x in labels]
    before, after = [-1] * n, [-1] * n
    last = -1
    for i in range(n):
        if decided[i]:
            last = i
        before[i] = last
    last = -1
    for i in range(n - 1, -1, -1):
        if decided[i]:
            last = i
        after[i] = last
    out = []
    for i, label in enumerate(labels):
        if decided[i]:
            out.append(label == "good")
            continue
        a, b = before[i], after[i]
        if a < 0 and b < 0:
            out.append(label == "near")
        elif a < 0 or b < 0:
            out.append(labels[max(a, b)] == "good")
        elif labels[a] == labels[b]:
            out.append(labels[a] == "good")
        elif i - a == b - i:
            out.append(False)
        else:
            out.append(labels[a if i - a < b - i else b] == "good")
    for i in range(n - 2, -1, -1):
        if headings[i] and labels[i] in ("short", "near") and out[i + 1]:
            out[i] = True
    return out


def extract(page: str) -> tuple[str, int, int]:
    """(text of the good blocks, a line each; all blocks; good blocks)."""
    parts, lang = blocks(page)
    stop = _STOP.get(lang[:2]) if lang else _ALL
    good = second_pass([first_pass(t, k, stop) for t, k, _ in parts], [h for _, _, h in parts])
    kept = [t for (t, _, _), g in zip(parts, good, strict=True) if g]
    return "\n".join(kept), len(parts), len(kept)


_ARROW = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_blocks", pa.int32()), ("n_good", pa.int32())])


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        done = [extract(x) if x is not None else (None, 0, 0) for x in b.column("html").to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url").cast(pa.string()), *(pa.array([d[i] for d in done], t) for i, t in enumerate((pa.string(), pa.int32(), pa.int32())))], schema=_ARROW)


def extract_pages(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_blocks, n_good) of every page.

    A null html gives a null text and no blocks; an empty page, or one without a good block, an empty text.  A null
    page_id or url stays null.  Repeated rows give a row each.  Very long pages are handled whole, in linear time
    however broken.  Of two decided blocks at equal distance that differ the bad one counts.  A page that states a
    language without a list in ``STOPWORDS`` is judged by lengths and links, one that states none by all lists.  An
    empty table gives no rows.  Other columns are ignored.
    """
    return pages.select(F.col("page_id").cast("long"), "url", "html").mapInArrow(_extract, "page_id long, url string, text string, n_blocks int, n_good int")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(spark.read.parquet(f"{sf_dir}/pages.parquet"))
