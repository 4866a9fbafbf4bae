"""Main text of web pages by union-free wrappers, inferred for each host from all its pages.

A page is read as a stream of blocks, each with its slot (a digest of the path of its block elements, with the
names of their classes and ids, chained from element to element, so that deep pages take linear space) and a text. Within a page neighbouring equal runs of slots fold into repeated
groups. The streams of a host are aligned one after another: what matches stays, what doesn't becomes
optional, so a wrapper is a row of groups, each once or repeated, always or at times there, with text
slots and no alternatives. Tasks fold their own pages, a wrapper for each host; partial wrappers are then
aligned in two rounds, salted first, so no task holds a host's pages. The slots of a host's row are its
fields: those that vary across its pages are content, those that are fixed are template, and each page is
matched to the row and keeps its blocks in content fields. Tags and names decide only what alignment can't:
furniture that varies (menus, advertisements, comments), link lists, and hosts of too few pages. Tables of
the rows up to ``BROADCAST_BYTES`` (measured first) are broadcast, larger ones joined by host.

Defined cases: null and empty pages have an empty text; a page of which the wrapper of its host
keeps nothing is judged by itself; null or broken urls share one host; repeated rows give repeated
results; unclosed elements end where their parents do; an empty table gives no rows; other columns are
not read.
"""

from __future__ import annotations

import html as entities
import json
import re
from bisect import bisect_right
from collections.abc import Iterator
from difflib import SequenceMatcher
from functools import lru_cache
from hashlib import blake2b

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.stage import staged

BROADCAST_BYTES = 32 << 20
SALTS = 64
#: A text that is the same on this many pages of a host that are unlike each other, and on all that have the field, is template,
#: unless such texts make up more than this share of all the host's text, as only copies of an article do.
CONSTANT_PAGES, COPIED_SHARE = 5, 0.75
LINK_SHARE = 0.5
#: Matchers, page shapes and names that a task remembers; it works them out again beyond.
MATCHERS, SHAPES, NAMED = 500, 500, 20_000

#: Fixed values of HTML: what a browser lays out as blocks, reads as raw text, or never shows as prose.
BLOCKS = frozenset("address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav noscript ol p pre search section summary table tbody td tfoot th thead tr ul button select svg template head label object".split())
VOID = frozenset("br hr img input meta link wbr area base col embed source track".split())
APART = frozenset("nav aside footer form noscript button select svg template head dialog search menu fieldset label object".split())
RAW = "script|style|title|textarea|iframe|xmp|noembed|noframes"
TOKEN = re.compile(rf"<!--.*?(?:-->|\Z)|<({RAW})\b[^>]*>.*?(?:</\1\s*>|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+|[^>]*)>", re.S | re.I)
CLOSED = re.compile(rf"</(?:{RAW})\s*>\Z", re.I)
NAMES = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
#: A class, id or role names furniture if all words between its hyphens are in one of these lists, one at least in the first.
FURNITURE = frozenset("nav navbar navigation menu sidebar foot footer pageheader siteheader masthead banner ad ads advert adverts advertisement advertisements advertising advertorial sponsor sponsored promo promotion cookie cookies consent notice notices alert comment comments disqus respond replies share sharing social related breadcrumb breadcrumbs newsletter subscribe popup modal widget login search pagination pager toolbar complementary contentinfo".split())
NEUTRAL = frozenset("0 area article bar block body bottom box button buttons card col column container content entry form global group icons inner item items left link links list main outer page pages panel post posts primary right row secondary section site slot text title top unit wrap wrapper".split())
#: Elements that are furniture even if they hold most of a page.
FIRM = frozenset("nav footer menu noscript button select svg template head search".split())
CONTENT = re.compile(r"(?:^|[-_ .])(?:main|article|content|post|entry|story|body-?text)(?=$|[-_ .])", re.I)


class Slot(str):
    """The digest of an element's path, with a ``+`` if it lies in an element marked as content; on the page it was
    read from it also knows its ``element``."""

    element: Element


class Element:
    """A block element of a page by its path: equal paths are one element. ``article`` and ``marked`` are the outermost
    elements around it, or it itself, that are marked as content; ``furniture`` is what its own tag or names say."""

    __slots__ = ("above", "tag", "depth", "key", "article", "marked", "within", "furniture", "slot")

    def __init__(self, above: Element | None, tag: str, part: str, key: str):
        self.above, self.tag, self.key = above, tag, key
        self.depth = above.depth + 1 if above else 0
        self.article = above and above.article or (self if tag == "article" else None)
        name = named(part)
        self.marked = above and above.marked or (self if (tag == "main" or CONTENT.search(part.partition(".")[2])) and not name else None)
        self.furniture = tag in APART or tag == "header" and not (above and above.within) or name
        self.within = bool(above and above.within) or tag in ("article", "main")
        self.slot = Slot(key + "+" * bool(self.core))
        self.slot.element = self

    @property
    def core(self) -> Element | None:
        """The element that is marked as the page's content, if this is in one."""
        return self.article or self.marked


def blocks(text: str | None) -> list[tuple[str, str, int]]:
    """A page's blocks in order: slot, text, and how many of its characters are links."""
    text, out = text or "", []
    root = Element(None, "", "", "")
    elements = {"": root}
    stack: list[Element] = [root]
    opened: dict[str, int] = {}
    pieces: list[str] = []
    linked: list[str] = []
    in_link = False

    def close() -> None:
        if pieces:
            line = " ".join(entities.unescape("".join(pieces)).split())
            if line:
                out.append((stack[-1].slot, line, min(len(line), len(" ".join(entities.unescape("".join(linked)).split())))))
            pieces.clear()
            linked.clear()

    def shut(size: int) -> None:
        while len(stack) > size:
            opened[stack.pop().tag] -= 1

    def add(piece: str) -> None:
        pieces.append(piece)
        if in_link:
            linked.append(piece)

    # Behind the last ">" there are no tags, so each "<" before it is looked through to a near end: linear time.
    at, last = 0, text.rfind(">") + 1
    for m in TOKEN.finditer(text, 0, last):
        if m.start() > at:
            add(text[at : m.start()])
        at = m.end()
        if at == last and (m[0].startswith("<!--") and not m[0].endswith("-->") or m[1] and not CLOSED.search(m[0])):
            at = last = len(text)  # a comment or raw text that never ends
        tag = (m[3] or "").lower()
        if tag == "a":
            in_link = not m[2]
        elif tag == "br":
            add(" ")
        elif tag in BLOCKS:
            close()
            in_link = False
            if m[2]:
                if opened.get(tag):
                    i = len(stack) - 1
                    while stack[i].tag != tag:
                        i -= 1
                    shut(i)
                continue
            # A block ends an open paragraph; items and cells end their like within the same list or table.
            if stack[-1].tag == "p":
                shut(len(stack) - 1)
            elif tag in ("li", "dt", "dd", "tr", "td", "th", "option"):
                like = ("td", "th") if tag in ("td", "th") else ("dt", "dd") if tag in ("dt", "dd") else (tag,)
                if any(opened.get(t) for t in like):
                    for i in range(len(stack) - 1, 0, -1):
                        if stack[i].tag in like:
                            shut(i)
                            break
                        if stack[i].tag in ("ul", "ol", "menu", "dl", "table"):
                            break
            if tag not in VOID:
                marks = [re.sub(r"\d+", "0", v) for _, *vs in NAMES.findall(m[4]) for v in vs if v]
                part = ".".join([tag, *(re.sub(r"[\s>]+", " ", v.strip()) for v in marks)])
                key = blake2b(f"{stack[-1].key}>{part}".encode("utf-8", "replace"), digest_size=12).hexdigest()
                if key not in elements:
                    elements[key] = Element(stack[-1], tag, part, key)
                stack.append(elements[key])
                opened[tag] = opened.get(tag, 0) + 1
    if at < len(text):
        add(text[at:].partition("<!--")[0])
    close()
    return out


def groups(slots: list[str]) -> list[tuple[tuple[str, ...], bool]]:
    """Fold neighbouring equal runs of any length, the shortest first, into repeated groups. A run that repeats starts
    with the same two slots again, so only such places are compared."""
    pairs: dict[tuple, list[int]] = {}
    for k, pair in enumerate(zip(slots, slots[1:], strict=False)):
        pairs.setdefault(pair, []).append(k)
    out, i = [], 0
    while i < len(slots):
        sizes = [1] if slots[i + 1 : i + 2] == slots[i : i + 1] else []
        if not sizes and i + 1 < len(slots):
            same = pairs[slots[i], slots[i + 1]]
            last = i + (len(slots) - i) // 2
            for k in same[bisect_right(same, i) :]:
                if k > last:
                    break
                if slots[i:k] == slots[k : 2 * k - i]:
                    sizes = [k - i]
                    break
        if sizes:
            run, n = slots[i : i + sizes[0]], 1
            while slots[i + n * sizes[0] : i + (n + 1) * sizes[0]] == run:
                n += 1
            out.append((tuple(run), True))
            i += n * sizes[0]
        else:
            out.append(((slots[i],), False))
            i += 1
    return out


class Wrapper:
    """``rows``: ``[slots, repeated, optional, facts]``, with a fact for each slot of the group, which is a
    field of the expression: up to ``CONSTANT_PAGES`` hashes of unlike pages that have it, characters, link
    characters and a hash of all its text on a page (null: it varies)."""

    def __init__(self, rows: list[list] | None = None):
        self.rows = None if rows is None else [[tuple(g), r, o, facts] for g, r, o, facts in rows]
        self.seen: dict[tuple, list[list]] = {}

    @property
    def groups(self) -> list[list]:
        return [row[:3] for row in self.rows or []]

    @classmethod
    def of(cls, page: list[tuple[str, str, int]]) -> Wrapper:
        found = groups([b[0] for b in page])
        rows = [[g, r, False, [[[], 0, 0, []] for _ in g]] for g, r in found]
        for (k, o), (_, text, links) in zip(places(found, [b[0] for b in page]), page, strict=True):
            fact = rows[k][3][o]
            fact[1:3] = fact[1] + len(text), fact[2] + links
            fact[3].append(text)
        for fact in (f for row in rows for f in row[3]):
            fact[3] = blake2b("\n".join(fact[3]).encode("utf-8", "replace"), digest_size=16).hexdigest()
        # Copies of a text count as one page, whatever is around them: a page is known by its longest field where that
        # is most of its text, else by all its text; furniture by name doesn't count.
        aside = apart(page)
        longest, mark = max(((fact[1] - fact[2], fact[3]) for g, _, _, facts in rows for slot, fact in zip(g, facts, strict=True) if slot not in aside), default=(0, ""))
        own = [b for b in page if b[0] not in aside]
        if 2 * longest <= sum(len(text) - links for _, text, links in own):
            mark = blake2b("\n".join(b[1] for b in own).encode("utf-8", "replace"), digest_size=16).hexdigest()
        known = mark[:16]
        for fact in (f for row in rows for f in row[3]):
            fact[0] = [known]
        return cls(rows)

    def align(self, other: Wrapper) -> None:
        shape = tuple((g, r, o) for g, r, o, _ in other.rows or [])
        if shape in self.seen:
            for mine, theirs in zip(self.seen[shape], other.rows or [], strict=True):
                add(mine[3], theirs[3])
            return
        if self.rows is None:
            self.rows = other.rows or []
            self.seen[shape] = list(self.rows)
            return
        theirs, out, at = other.rows or [], [], []
        for kind, a, b, c, d in SequenceMatcher(None, [r[0] for r in self.rows], [r[0] for r in theirs], autojunk=False).get_opcodes():
            if kind == "equal":
                for row, its in zip(self.rows[a:b], theirs[c:d], strict=True):
                    row[1:3] = row[1] or its[1], row[2] or its[2]
                    add(row[3], its[3])
                out += self.rows[a:b]
                at += self.rows[a:b]
            else:  # only one of the two has it
                for row in [*self.rows[a:b], *theirs[c:d]]:
                    row[2] = True
                out += [*self.rows[a:b], *theirs[c:d]]
                at += theirs[c:d]
        self.rows = out
        self.seen[shape] = at

    def chosen(self) -> list[list]:
        """The expression with, for each field, whether it is content: ``[slots, fields]``."""
        facts = [fact for *_, facts in self.rows or [] for fact in facts]
        plain, still = (sum(f[1] - f[2] for f in some) for some in (facts, filter(fixed, facts)))
        copied = still > COPIED_SHARE * plain
        return [[g, [content(slot, fact, r, o, copied) for slot, fact in zip(g, its, strict=True)]] for g, r, o, its in self.rows or []]


def fixed(fact: list) -> bool:
    """Whether a field has the same text on all pages that have it, and on unlike pages enough."""
    return fact[3] is not None and len(fact[0]) >= CONSTANT_PAGES


def add(mine: list[list], theirs: list[list]) -> None:
    for old, new in zip(mine, theirs, strict=True):
        old[:] = sorted({*old[0], *new[0]})[:CONSTANT_PAGES], old[1] + new[1], old[2] + new[2], old[3] if old[3] == new[3] else None


def places(found: list[tuple[tuple[str, ...], bool]], slots: list[str]) -> list[tuple[int, int]]:
    """For each slot of a page its group and its place within the group."""
    out: list[tuple[int, int]] = []
    for k, (g, repeated) in enumerate(found):
        while tuple(slots[len(out) : len(out) + len(g)]) == g:
            out += [(k, o) for o in range(len(g))]
            if not repeated:
                break
    return out


def content(slot: str, fact: list, repeated: bool, optional: bool, copied: bool) -> bool:
    """Fields that vary across pages are content and fixed ones template. Where the pages don't tell (too few or
    copies, or a fixed field that only some of them have, in an element marked as content), the slot's names do."""
    _, chars, links, _ = fact
    inside = slot.endswith("+")
    if fixed(fact) and not copied and not (inside and optional):
        return False
    return inside or links <= (LINK_SHARE if repeated else 0.8) * chars


class Matcher:
    """A host's expression, to match its pages to: which of their blocks are main text."""

    def __init__(self, expression: list[list]):
        self.fields = [f for _, f in expression]
        self.matcher = SequenceMatcher(None, autojunk=False)
        self.matcher.set_seq2([tuple(g) for g, _ in expression])
        self.anywhere: dict[str, bool] = {}
        for g, fields in expression:
            for slot, f in zip(g, fields, strict=True):
                self.anywhere[slot] = self.anywhere.get(slot, False) or f
        self.shapes: dict[bytes, list[bool]] = {}

    def content(self, slots: list[str]) -> list[bool]:
        """For each slot of a page whether its field is content; out of line with the expression, whether any of its fields is."""
        key = blake2b("\n".join(slots).encode("utf-8", "replace"), digest_size=16).digest()
        if key not in self.shapes:
            found = groups(slots)
            self.matcher.set_seq1([g for g, _ in found])
            fields: dict[int, list[bool]] = {}
            for a, b, n in self.matcher.get_matching_blocks():
                fields |= {a + i: self.fields[b + i] for i in range(n)}
            if len(self.shapes) >= SHAPES:
                self.shapes.clear()
            self.shapes[key] = [fields[k][o] if k in fields else self.anywhere.get(slot, True) for (k, o), slot in zip(places(found, slots), slots, strict=True)]
        return self.shapes[key]

    def main(self, page: list[tuple[str, str, int]]) -> list[str]:
        """The texts of the page's main text."""
        aside = apart(page)
        return [text for (slot, text, _), keep in zip(page, self.content([b[0] for b in page]), strict=True) if keep and slot not in aside]


@lru_cache(NAMED)
def named(part: str) -> bool:
    """Whether an element's class, id or role names furniture, as a whole."""
    tag, _, names = part.partition(".")
    if tag in ("html", "body", "article", "main"):
        return False
    for token in re.split(r"[ .]+", names.lower()):
        words = re.split("[-_]+", re.sub(r"(side)[-_](bar)|(page|site)[-_](header)", lambda m: m[0].replace("-", "").replace("_", ""), token))
        words = [re.sub("(?<=[a-z])0$", "", w) for w in words if w]
        if any(w in FURNITURE for w in words) and all(w in FURNITURE or w in NEUTRAL for w in words):
            return True
    return False


def apart(page: list[tuple[str, str, int]]) -> set[str]:
    """The slots of a page that are furniture. An element that holds all of what is marked as content, or
    most of the page's text and a mark where there are any, isn't furniture whatever its name."""
    held: dict[Element, list[int]] = {}  # plain characters of an element, and marked elements strictly within it
    for slot, text, links in page:
        own = element = getattr(slot, "element", None)
        while element and element not in held:
            held[element] = [0, 0]
            element = element.above
        if own:
            held[own][0] += len(text) - links
    homes = {slot.element.core for slot, _, _ in page if hasattr(slot, "element")} - {None}
    inward = sorted(held, key=lambda e: e.depth)
    for element in reversed(inward):
        if element.above:
            above = held[element.above]
            above[0] += held[element][0]
            above[1] += held[element][1] + (element in homes)
    total = held[inward[0]][0] if inward else 0
    gone: dict[Element, bool] = {}
    for element in inward:
        chars, marks = held[element]
        most = 2 * chars > total and (marks or not homes)
        stays = element.tag not in FIRM and (homes and marks == len(homes) or most)
        gone[element] = bool(element.above and gone[element.above] or element.furniture and not stays)
    return {element.slot for element, out in gone.items() if out}


def partial_wrappers(pages: DataFrame) -> DataFrame:
    """Per task, host and shape (a page's groups) one wrapper, with the facts of all its pages: ``host, shape, salt, wrapper``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, str], Wrapper] = {}
        for batch in batches:
            for host, html in zip(batch.column("host").to_pylist(), batch.column("html"), strict=True):
                page = Wrapper.of(blocks(html.as_py()))
                shape = blake2b(json.dumps(page.groups).encode("utf-8", "replace"), digest_size=16).hexdigest()
                held.setdefault((host, shape), Wrapper()).align(page)
            if len(held) >= 10_000:
                yield rows(held)
                held = {}
        yield rows(held)

    def rows(held: dict[tuple[str, str], Wrapper]) -> pa.RecordBatch:
        salt = TaskContext.get().partitionId() % SALTS
        return pa.RecordBatch.from_arrays([pa.array([h for h, _ in held], pa.string()), pa.array([s for _, s in held], pa.string()), pa.array([salt] * len(held), pa.int32()), pa.array([json.dumps(w.rows or []) for w in held.values()], pa.string())], names=["host", "shape", "salt", "wrapper"])

    return pages.mapInArrow(run, "host string, shape string, salt int, wrapper string")


def merged(wrappers: DataFrame, keys: list[str]) -> DataFrame:
    """Align the wrappers of one key in the order of their texts, so that the outcome is the same each time: ``keys, wrapper``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for each in batch.column("wrappers"):
                whole = Wrapper()
                for w in each:
                    whole.align(Wrapper(json.loads(w.as_py())))
                out.append(json.dumps(whole.rows or []))
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keys), pa.array(out, pa.string())], names=[*keys, "wrapper"])

    lists = wrappers.groupBy(*keys).agg(F.sort_array(F.collect_list("wrapper")).alias("wrappers"))
    kinds = dict(lists.dtypes)
    return lists.mapInArrow(run, ", ".join(f"{k} {kinds[k]}" for k in keys) + ", wrapper string")


def wrappers(pages: DataFrame) -> DataFrame:
    """``host, wrapper`` (JSON of its rows), inferred from all pages of each host. Pages of one shape are summed up
    first, in any order; shapes are aligned in a fixed order, so neither splits nor tasks change the outcome."""
    shapes = merged(merged(staged(partial_wrappers(pages), "wrappers-partial"), ["host", "shape", "salt"]), ["host", "shape"])
    folded = shapes.withColumn("fold", F.pmod(F.xxhash64("shape"), F.lit(SALTS)).cast("int"))
    return merged(merged(folded, ["host", "fold"]), ["host"])


def chosen(wrapped: DataFrame) -> DataFrame:
    """``host, rules``: its expression with the fields that are content (JSON)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rules = [json.dumps(Wrapper(json.loads(w)).chosen()) for w in batch.column("wrapper").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("host"), pa.array(rules, pa.string())], names=["host", "rules"])

    return wrapped.mapInArrow(run, "host string, rules string")


def extracted(pages: DataFrame) -> DataFrame:
    """Per page row ``page_id, url, text, n_chars``."""
    found = pages.select("page_id", "url", F.coalesce(F.lower(F.regexp_extract(F.col("url"), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)), F.lit("")).alias("host"), "html")
    rules = staged(chosen(wrappers(found.select("host", "html"))), "wrappers-slots")
    size = rules.agg(F.coalesce(F.sum(F.length("rules") + F.length("host")), F.lit(0)).alias("n")).first()["n"]
    both = found.join(F.broadcast(rules) if size <= BROADCAST_BYTES else rules, "host", "left").select("page_id", "url", "html", "rules")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matchers: dict[str, Matcher] = {}
        for batch in batches:
            texts = []
            for html, rules in zip(batch.column("html"), batch.column("rules"), strict=True):
                page, expression = blocks(html.as_py()), rules.as_py() or "[]"
                if expression not in matchers:
                    if len(matchers) >= MATCHERS:
                        matchers.clear()
                    matchers[expression] = Matcher(json.loads(expression))
                kept = matchers[expression].main(page)
                if not kept and page:
                    kept = Matcher(Wrapper.of(page).chosen()).main(page)
                texts.append(" ".join(kept))
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return both.mapInArrow(run, f"page_id {dict(pages.dtypes)['page_id']}, url string, text string, n_chars bigint")
