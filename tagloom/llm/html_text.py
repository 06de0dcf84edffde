"""HTML extraction by equivalence-class template deduction.

The template is deduced from all pages of a host, however many. Tokens (block tags with their class; an end tag counts with its
start tag's) that occur equally often on every page form a class. A class is valid if its tokens come in the same order on each
of its pages; valid classes that stand in one gap of another are nested there. Pages without tags are left out. The largest
valid class whose tokens occur once on each of at least SUPPORT of the pages is the root; slots are judged on the pages that
have them. The gaps between its tags are slots, and so are the records that nested tags begin in a gap. Text of a slot or record
that stands on all of its three or more unlike pages is boilerplate, in the article or not. Words and inline tags (b, a, span)
cut no slot, as they stand within sentences, so they are not counted. Of the other slots, tags, roles and class names choose:
those in menus, headers, footers, sidebars, notices, adverts, forms and reader comments are left out, and if a page marks an
article, only the slots in it count. Inside an article a class name must say nothing else to leave its element out, and nothing is
left out for being hidden.

Text: character references are decoded; block tags end a block, line breaks are white space; white space in a block becomes one
space; blocks are joined by an empty line.  Comments, scripts and styles are markup.

Occurrence vectors are compared by 63-bit sums of hashes over (page, number); orders, gaps and repeated texts are bits and sets
that tasks add up for their own pages and then join, so the result doesn't depend on how pages are dealt out. A page whose host
has fewer than three unlike pages gets the same extraction with an empty template. Edge cases: null and empty html give an empty
text; a null url is a host of its own; broken markup is read as far as it goes (a lone ``<`` is text, an unclosed script runs to
the end); repeated pages each get a row; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import json
import re
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, materialize, prepare, table, tidied

#: The share of a host's pages on which a class must occur.
SUPPORT = 0.6
#: Unlike pages that must have a slot before a text on all of them counts as boilerplate.
UNLIKE = 3

_TOKEN = re.compile(r"""<!--.*?-->|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?>(?:[^>"']|"[^"]*"|'[^']*')*))>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>|([^<]+)|(<)""", re.S)
_ATTRIBUTE = re.compile(r"""([a-zA-Z_:][-\w:.]*)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_RAW = {"script", "style", "template", "iframe", "svg", "textarea", "noscript", "title", "xmp", "object", "canvas"}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
_BLOCK = {"address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "dialog", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "html", "legend", "li", "main", "menu", "nav", "ol", "p", "pre", "section", "summary", "table", "tbody", "tfoot", "thead", "tr", "ul"}
_SPACE = {"br", "td", "th", "option", "wbr"}
_OUT_TAGS = {"nav", "footer", "aside", "form", "button", "select", "head", "menu", "dialog", "label"}
_OUT_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "alert", "alertdialog", "dialog", "menu", "form"}
#: Words of class names and ids that mark what is not the article.
_OUT_WORDS = frozenset("ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert popup modal overlay sidebar side aside rail menu menus nav navbar navigation breadcrumb breadcrumbs topbar toolbar header masthead footer copyright comment comments reply replies respond discussion share sharing social related recommended newsletter subscribe subscription signup login search widget pagination pager form".split())
#: Words that may stand beside those in the name of a class. Inside an article, a name counts only if it holds nothing else:
#: "social-share-box" is no article, "share-of-market" may be part of one.
_NEUTRAL_WORDS = frozenset("area bar block body bottom box center col column container content div fixed group inner inline item items js left line link links list main mobile module outer page panel right row section site slot small sticky text title top unit widget wrap wrapper zone".split())
#: Tags that cut a page into runs of text.  Inline tags stand within a sentence, and what follows one is no slot.
_CUT = _BLOCK | {"td", "th"}
_PRIME = 2**61 - 31


@dataclass
class Event:
    """A tag (kind 1 opens, -1 closes) or a piece of text (kind 0)."""

    kind: int
    name: str  # of a tag; the text otherwise
    token: str = ""  # how a tag counts for the template
    out: bool = False  # what it holds is not of the article
    main: bool = False
    hint: bool = False  # it is not of the article, unless it stands inside one


def _marks_out(name: str) -> bool:
    """Whether the name of a class or an id holds words for what is not the article, and none but neutral ones beside them."""
    words = set(re.split(r"[^a-z0-9]+", name)) - {""}
    return bool(words & _OUT_WORDS) and words <= _OUT_WORDS | _NEUTRAL_WORDS


def events(html: str) -> list[Event]:
    found, at = [], 0
    while at < len(html):
        m = _TOKEN.match(html, at)
        at = m.end()
        if m[7] or m[8]:
            found.append(Event(0, m[0]))
            continue
        name = (m[2] or m[5] or "").lower()
        if not name:
            continue
        if m[1] or m[4]:
            found.append(Event(-1, name, f"</{name}>"))
            continue
        raw = m[3] if m[2] else m[6]
        attributes = {a[0].lower(): unescape(a[1] or a[2] or a[3]) for a in _ATTRIBUTE.findall(raw)} if raw else {}
        words = set(re.split(r"[^a-z0-9]+", f"{attributes.get('class', '')} {attributes.get('id', '')}".lower())) - {""}
        role = attributes.get("role", "").lower()
        page = name in ("html", "body")
        main = not page and (name in ("article", "main") or role in ("main", "article") or attributes.get("itemprop") == "articleBody")
        hint = not page and bool(words & _OUT_WORDS) and not (main and not words & {"comment", "comments", "reply"})
        out = name in _OUT_TAGS or role in _OUT_ROLES or hint and (main or any(_marks_out(x) for x in f"{attributes.get('class', '')} {attributes.get('id', '')}".lower().split()))
        found.append(Event(1, name, f"<{name} {' '.join(sorted(words))}>", out, main and not out, hint))
        if name in _RAW:
            end = re.compile(rf"</{name}\b[^>]*>", re.I).search(html, at)
            at = end.end() if end else len(html)
            found.append(Event(-1, name, f"</{name}>"))
    return found


@dataclass
class Class:
    """Tokens with one occurrence vector, in their order; nested holds the valid classes in each gap."""

    tokens: list[str]
    support: int
    nested: dict[int, list[Class]] = field(default_factory=lambda: defaultdict(list))


def runs_of(page: list[Event]) -> tuple[list[str], list[int], list[int]]:
    """The tokens that cut a page; a fingerprint and the bytes of the text before the first and after each, white space left out."""
    tokens, parts, stack = [], [[]], []
    for e in page:
        if e.kind == 0:
            parts[-1].append(e.name)
        elif e.name in _CUT:
            token = e.token
            if e.kind == 1 and e.name not in _VOID:
                stack.append(e)
            for k in range(len(stack) - 1, -1, -1) if e.kind == -1 else ():
                if stack[k].name == e.name:  # an end tag counts as that of its start tag, with the class
                    token = "</" + stack[k].token[1:]
                    del stack[k:]
                    break
            tokens.append(token)
            parts.append([])
    texts = ["".join("".join(x).split()).encode("utf-8", "replace") for x in parts]
    return tokens, [int.from_bytes(x, "big") % _PRIME for x in texts], [len(x) for x in texts]


def count(tokens: list[str], page: int, counts: dict[str, list[int]]) -> None:
    """Add a page to the sums of each token: pages, occurrences, and two fingerprints of the occurrence vector."""
    for token, n in Counter(tokens).items():
        h = hash((page, n))
        for k, x in enumerate((1, n, h & 0xFFFFFFFF, h >> 32 & 0x7FFFFFFF)):
            counts.setdefault(token, [0, 0, 0, 0])[k] += x


def classes(counts: dict[str, list[int]], pages: int) -> list[list]:
    """Tokens, support, and whether they are once on each page, of the classes that occur on enough of the pages."""
    groups = defaultdict(list)
    for token, sums in counts.items():
        if sums[0] >= max(2, SUPPORT * pages):
            groups[tuple(sums)].append(token)
    return [[tokens, x[0], x[0] == x[1]] for x, tokens in sorted((x, sorted(t)) for x, t in groups.items()) if len(tokens) > 1 or x[0] == x[1]]


def relate(tokens: list[str], found: list[list], state: dict) -> None:
    """Add the order of a page's tokens to the state: what comes before and after each token (as bits), and the order in each class."""
    number = {t: k for k, t in enumerate(t for c in found for t in c[0])}
    of = [k for k, c in enumerate(found) for _ in c[0]]
    line = [number[t] for t in tokens if t in number]
    for way, towards in (("after", line[::-1]), ("before", line)):
        seen, near, last = 0, set(), {t: k for k, t in enumerate(towards)}
        for k, t in enumerate(towards):
            if t not in near:
                near.add(t)
                seen |= 1 << t
            if last[t] == k:
                state[way][t] = state[way].get(t, 0) | seen & ~(1 << t)
    by = defaultdict(list)
    for t in line:
        by[of[t]].append(t)
    for k, x in by.items():
        order = x[: len(found[k][0])]
        if not found[k][2]:
            state["order"][k] = order if x == order * (len(x) // len(order)) and state["order"].get(k, order) == order else []


def merge_relations(state: dict, more: dict) -> None:
    for way in ("after", "before"):
        for t, x in more[way].items():
            state[way][int(t)] = state[way].get(int(t), 0) | x
    for k, x in more["order"].items():
        state["order"][int(k)] = x if state["order"].get(int(k), x) == x else []


def no_relations() -> dict:
    return {"after": {}, "before": {}, "order": {}}


def root_of(found: list[list], state: dict) -> Class | None:
    """The root: of the classes that are once on a page, that with most tokens in one order; other valid classes nested in its gaps."""
    names = [t for c in found for t in c[0]]
    before, after = state["before"], state["after"]
    clash = {t: before[t] & after[t] for t in before}
    valid, at = [], 0
    for k, (tokens, support, once) in enumerate(found):
        inside, at = [t for t in range(at, at + len(tokens)) if t in clash], at + len(tokens)
        if not once:
            kept = state["order"].get(k) or []
        else:  # tags that stand in other places on other pages are no template; those between them still are
            every, mask, kept = sum(1 << t for t in inside), 0, []
            for t in sorted(inside, key=lambda t: ((clash[t] & every).bit_count(), t)):  # noqa: B023
                if not clash[t] & mask:
                    mask |= 1 << t
                    kept.append(t)
            kept.sort(key=lambda t: (before[t] & mask).bit_count())  # noqa: B023
        if kept:
            valid.append((kept, support, once))
    best = max((x for x in valid if x[2]), key=lambda x: (len(x[0]), x[1], [-t for t in x[0]]), default=None)
    if best is None:
        return None
    mask = sum(1 << t for t in best[0])
    root = Class([names[t] for t in best[0]], best[1])
    for x in valid:
        gaps = {None if clash[t] & mask else (before[t] & mask).bit_count() for t in x[0]}
        if x is not best and len(gaps) == 1 and None not in gaps:
            root.nested[gaps.pop()].append(Class([names[t] for t in x[0]], x[1]))
    return root


def template(pages: list[list[str]]) -> Class | None:
    """The root class of some pages (as tokens), other valid classes nested in its gaps; None without one."""
    counts, state = {}, no_relations()
    for k, page in enumerate(pages):
        count(page, k, counts)
    found = classes(counts, sum(map(bool, pages)))
    for page in pages:
        relate(page, found, state)
    return root_of(found, state)


def places(root: Class | None) -> list[dict[str, int]]:
    """The gap that begins at each token of the root, and the gap in which each nested token stands."""
    return [{t: k for k, t in enumerate(root.tokens, 1)}, {t: g for g, x in root.nested.items() for c in x for t in c.tokens}] if root else [{}, {}]


def records(tokens: list[str], texts: list[int], sizes: list[int], where: list[dict[str, int]]) -> tuple[list[int], list[tuple[str, int]]]:
    """The record of each run of text, and slot and text of each record: a slot begins at a token of the root or of a class nested there."""
    gaps, nested = where
    gap, of, found = 0, [0], [["0", 0, 0]]
    for t in tokens:
        if t in gaps or nested.get(t) == gap:
            gap = gaps.get(t, gap)
            found.append([f"{gap}" if t in gaps else f"{gap}{t}", 0, 0])
        of.append(len(found) - 1)
    for r, text, n in zip(of, texts, sizes, strict=True):
        if n:
            x = found[r]
            x[1:] = (x[1] * pow(256, n, _PRIME) + text) % _PRIME, x[2] + n
    return of, [(slot, text << 32 | n if n else 0) for slot, text, n in found]


def compare(page: int, runs: tuple, where: list[dict[str, int]], state: dict) -> None:
    """Add a page to the state of each slot: the texts of its records on all pages that have it, and up to UNLIKE unlike pages."""
    if not where[0].keys() <= set(runs[0]):
        return
    by = defaultdict(set)
    for slot, text in records(*runs, where)[1]:
        by[slot] |= {text} - {0}
    merge_texts(state, {slot: [texts, [page]] for slot, texts in by.items()})


def merge_texts(state: dict, more: dict) -> None:
    for slot, (texts, unlike) in more.items():
        old = state.get(slot, [texts, unlike])
        state[slot] = [set(old[0]) & set(texts), sorted({*old[1], *unlike})[:UNLIKE]]


def repeated(state: dict) -> dict[str, list[int]]:
    """Of each slot, the texts that stand on all of its three or more unlike pages."""
    return {slot: sorted(texts) for slot, (texts, unlike) in state.items() if texts and len(unlike) >= UNLIKE}


@dataclass
class Piece:
    """A piece of text, its run, and whether it is in the article or out of it."""

    text: str
    run: int
    out: bool
    main: bool
    block: int


def pieces(page: list[Event]) -> list[Piece]:
    found, stack, run, block = [], [], 0, 0
    for e in page:
        if e.kind:
            run += e.name in _CUT
            block += e.name in _BLOCK
            if e.name in _SPACE:
                found.append(Piece(" ", run, any(x.out for x in stack), any(x.main for x in stack), block))
        if e.kind == 1 and e.name not in _VOID:
            if e.name in _BLOCK:  # a block ends a paragraph that is open
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k].name == "p":
                        del stack[k:]
                        break
                    if stack[k].name in _BLOCK:
                        break
            inside = any(x.main for x in stack)
            if not inside and (e.hint or e.name == "header"):
                e = Event(1, e.name, e.token, True)
            stack.append(e)
        elif e.kind == -1:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k].name == e.name:
                    del stack[k:]
                    break
        elif e.kind == 0:
            found.append(Piece(e.name, run, any(x.out for x in stack), any(x.main for x in stack), block))
    return found


def main_text(page: list[Event], runs: tuple, where: list[dict[str, int]], same: dict[str, list[int]]) -> str:
    """The text of a page's slots, without repeated records and without what tags and class names mark as out of the article."""
    kept = [x for x in pieces(page) if not x.out]
    if any(x.main and x.text.strip() for x in kept):
        kept = [x for x in kept if x.main]
    if same and where[0].keys() <= set(runs[0]):
        of, found = records(*runs, where)
        drop = {r for r, (slot, text) in enumerate(found) if text in same.get(slot, ())}
        kept = [x for x in kept if of[x.run] not in drop]
    blocks = defaultdict(list)
    for x in kept:
        blocks[x.block].append(x.text)
    lines = (" ".join(unescape("".join(b)).split()) for b in blocks.values())
    return "\n\n".join(x for x in lines if x)


def extract(group: list[str]) -> list[str]:
    """The main text of each page of one host."""
    parsed = [events(html) for html in group]
    runs = [runs_of(p) for p in parsed]
    where = places(template([r[0] for r in runs])) if len(group) > 1 else [{}, {}]
    state, first = {}, {}
    for html, r in zip(group, runs, strict=True):
        compare(first.setdefault(html, len(first)), r, where, state)
    same = repeated(state) if where[0] else {}
    return [main_text(p, r, where, same) for p, r in zip(parsed, runs, strict=True)]


def batch_of(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [[]] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


#: Templates of up to so many bytes are broadcast; more of them are joined by a shuffle, in which Spark splits large hosts.
BROADCAST = 8 << 20
#: Tokens of different hosts that a task adds up before it passes them on.
COUNTS = 200_000


def attach(rows: DataFrame, states: DataFrame, how: str = "inner") -> DataFrame:
    """Give each row its host's state."""
    size = states.agg(F.sum(F.length("host") + F.length("state"))).head()[0] or 0
    return rows.join(F.broadcast(states) if size <= BROADCAST else states, "host", how)


def merged(partial: DataFrame, one: Callable[[list[dict], dict | None], object], name: str) -> DataFrame:
    """One state a host from those of the tasks: as many as tasks hold pages of it, each of a size that its pages don't change."""
    kind = pa.schema([("host", pa.string()), ("state", pa.string())])

    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for host, known, parts in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                state = one(list(map(json.loads, parts)), json.loads(known))
                rows += [(host, json.dumps(state))] if state else []
            yield batch_of(rows, kind)

    by = partial.groupBy("host").agg(F.first("known").alias("known"), F.collect_list("part").alias("parts"))
    return materialize(by.mapInArrow(run, "host string, state string"), name)


def partials(rows: DataFrame, start: Callable[[], dict], add: Callable[[dict, dict, int, tuple], None]) -> DataFrame:
    """host, known (its state so far), part: what a task's pages add."""
    kind = pa.schema([("host", pa.string()), ("known", pa.string()), ("part", pa.string())])

    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, known, seen = {}, {}, set()

        def done() -> pa.RecordBatch:
            out = batch_of([(k, known[k][0], json.dumps(v, default=sorted)) for k, v in parts.items()], kind)
            parts.clear(), known.clear(), seen.clear()
            return out

        for batch in batches:
            for host, page, tokens, texts, sizes, state in zip(*(batch.column(k).to_pylist() for k in range(6)), strict=True):
                if host not in parts:
                    if len(parts) >= 1000:
                        yield done()
                    parts[host], known[host] = start(), (state, json.loads(state))
                if (host, page) not in seen:  # exact copies add nothing
                    seen.add((host, page))
                    add(parts[host], known[host][1], page, (tokens, texts, sizes))
        yield done()

    return rows.select("host", "page", "tokens", "texts", "sizes", "state").mapInArrow(run, "host string, known string, part string")


def templates(pages: DataFrame) -> DataFrame:
    """host, state: tokens of the root and of nested classes, and the repeated texts of slots, of hosts that have such texts.

    Each step adds up all pages of a host in each task first and joins the sums, so a host of any size has one template.
    """
    runs_kind = pa.schema([("host", pa.string()), ("page", pa.int64()), ("tokens", pa.list_(pa.string())), ("texts", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int64()))])

    @tidied
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = ((host, page, *runs_of(events(html))) for host, page, html in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True))
            yield batch_of([r for r in rows if r[2]], runs_kind)

    @tidied
    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, n = defaultdict(dict), 0

        def done() -> pa.RecordBatch:
            out = batch_of([(host, t, *x) for host, by in counts.items() for t, x in by.items()], sums_kind)
            counts.clear()
            return out

        for batch in batches:
            for host, page, tokens in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                by = counts[host]
                n -= len(by)
                count(tokens, page, by)
                count([""], page, by)  # the host's pages
                n += len(by)
                if n >= COUNTS:
                    yield done()
                    n = 0
        yield done()

    sums_kind = pa.schema([("host", pa.string()), ("token", pa.string()), *((x, pa.int64()) for x in "abcd")])
    some = pages.where("length(html) > 0").select("host", F.xxhash64("html").alias("page"), "html")
    runs = materialize(some.mapInArrow(cut, "host string, page long, tokens array<string>, texts array<long>, sizes array<long>"), "runs")
    counts = runs.select("host", "page", "tokens").mapInArrow(sums, "host string, token string, a long, b long, c long, d long")
    counts = materialize(counts.groupBy("host", "token").agg(*(F.sum(x).alias(x) for x in "abcd")), "tokens")
    hosts = counts.where(f"token = '' AND a >= {UNLIKE}").select("host", F.col("a").alias("pages"))
    frequent = counts.where("token <> '' AND a >= 2").join(hosts, "host").where(F.col("a") >= SUPPORT * F.col("pages"))
    found = frequent.groupBy("host").agg(F.first("pages").alias("pages"), F.collect_list(F.struct("token", *"abcd")).alias("tokens"))
    kind = pa.schema([("host", pa.string()), ("state", pa.string())])

    @tidied
    def classed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for host, n, tokens in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                rows.append((host, json.dumps(classes({x["token"]: [x[k] for k in "abcd"] for x in tokens}, n))))
            yield batch_of(rows, kind)

    found = materialize(found.mapInArrow(classed, "host string, state string"), "classes")

    def rooted(parts: list[dict], known: list) -> list | None:
        state = no_relations()
        for x in parts:
            merge_relations(state, x)
        root = root_of(known, state)
        return places(root) if root else None

    roots = merged(partials(attach(runs, found), no_relations, lambda state, known, _, r: relate(r[0], known, state)), rooted, "roots")

    def alike(parts: list[dict], known: list) -> list | None:
        state = {}
        for x in parts:
            merge_texts(state, x)
        same = repeated(state)
        return [known, same] if same else None

    out = merged(partials(attach(runs, roots), dict, lambda state, known, page, r: compare(page, r, known, state)), alike, "templates")
    for x in (runs, counts, found, roots):
        discard(x)
    return out


TEXTS = "page_id long, url string, text string, n_chars long"


def main_texts(pages: DataFrame) -> DataFrame:
    kind = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])

    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, known = [], {None: [[{}, {}], {}]}
            for page_id, url, html, state in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                if state not in known:
                    known[state] = json.loads(state)
                where, same = known[state]
                page = events(html or "")
                text = main_text(page, runs_of(page) if same else (), where, same)
                rows.append((page_id, url, text, len(text)))
            yield batch_of(rows, kind)

    prepare(pages.sparkSession)
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1))
    rows = pages.select("page_id", "url", "html", host.alias("host"))
    return attach(rows, templates(rows), "left").select("page_id", "url", "html", "state").mapInArrow(run, TEXTS)


def op9_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_texts(table(spark, sf_dir, "pages"))
