"""Main-text extraction by equivalence-class template deduction.

Each page is read as tokens: opening and closing tags and the texts of whole blocks, each told apart by its path of open
block elements (a block is never taken apart, so no word of an article goes missing). Per host, a token's occurrence vector is its
count on every distinct page, held as a sum of hashes of (page, count), which combines map-side and so bears a host of any size.
Tokens of one host sharing a vector form an equivalence class, on at least min_pages distinct pages and a share of the host's; a class
of two tokens or more with a tag among them is a candidate. So each layout of a host has classes of its own, and an error page or a
second layout takes nothing from the others.

A candidate is valid when its tokens first stand in one order on AGREE of its pages; the order is the pages' commonest. A class is nested in
slot k of another, whose tokens stand once on a page, when all its tokens lie between that class's tokens k and k + 1 on AGREE of
its pages; of several such classes the one that begins nearest before it is its parent. The valid classes, nested, are the host's template.

On each page the template's tokens are matched in order, each class inside its parent's slot: matched texts are template text, and what
is left are the slots. Of the slots' texts, those are the main text that no menu, header, footer, sidebar, notice, advert, form, script,
style or comment element encloses, and that lie inside the article element where a page has one. Class, id and role words count as such
an element only where every word of the name speaks of one (`site-nav`, not `related-work`).

A template holds at most 1 / share times the tokens of an average page of its host. Templates are broadcast while their tokens stay below
a checked bound and joined by host otherwise.

Defined cases: null html counts as empty; pages without tokens count for no host; a null url is a host of its own; hosts with fewer than min_pages
distinct pages have no template, only the element rules; unclosed elements end with their parent or the page; a page of any depth is read in
time linear in its length; pages of a host that are equal count once in deduction and are extracted each; columns other than page_id, url
and html are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import html as entities
import re
from bisect import bisect_left
from collections import Counter

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stage

#: Share of a class's pages that must agree on its order and its place.
AGREE = 0.9
#: Template tokens are broadcast up to this many in all (24 bytes each).
BROADCAST_TOKENS = 2_000_000

# Element names by role.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style noscript template textarea title iframe xmp svg math object canvas".split())
BLOCK = set("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
DROPPED = set("nav header footer aside form menu button select option label input dialog fieldset head".split()) | RAW
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
ENDS_P = BLOCK - {"body", "html"}

# Class, id and role words of what is not the article.
NOISE = set(
    "ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner sidebar sidebars aside menu menus nav navbar navigation "
    "breadcrumb breadcrumbs footer header masthead topbar toolbar comment comments commentlist disqus replies respond cookie cookies consent gdpr notice notices "
    "alert newsletter subscribe subscription signup login share sharing social related recommended widget widgets popup modal overlay pagination pager "
    "skip complementary contentinfo search searchbox dialog form".split()
)
# Words that stand beside those in a name without changing its sense.
NEUTRAL = set("site main page top bottom left right upper lower primary secondary global local mobile desktop box list container wrapper wrap inner outer bar area section block link links item items panel content text unit slot fixed sticky js id".split())
_TAG = re.compile(r"<!--.*?(?:--\s*>|\Z)|<![^>]*>|<\?[^>]*>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*)>", re.S)
_ATTRIBUTE = re.compile(r"\b(class|id|role|hidden|aria-hidden|style)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
_WORD = re.compile(r"[a-z]+|[A-Z]+(?![a-z])|[A-Z][a-z]*")
_END = {name: re.compile(rf"</{name}\s*>|</{name}\s[^>]*>", re.I) for name in RAW}


def _noisy(attributes: str) -> bool:
    for m in _ATTRIBUTE.finditer(attributes):
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if name == "hidden" or name == "aria-hidden" and value.lower() == "true":
            return True
        if name == "style":
            if re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
                return True
        elif any(map(_noise_name, value.split())):
            return True
    return False


def _noise_name(name: str) -> bool:
    """Whether a class or id names what is not the article, and nothing else."""
    words = [w.lower() for w in _WORD.findall(name)]
    return any(w in NOISE for w in words) and all(w in NOISE or w in NEUTRAL for w in words)


def _hash(text: str) -> int:
    return xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass")) - (1 << 63)


_NAMES: dict[str, int] = {}


def _below(path: int, name: str) -> int:
    """The token of an element under a path of open blocks; also the path that it opens."""
    if name not in _NAMES:
        if len(_NAMES) > 10_000:
            _NAMES.clear()
        _NAMES[name] = _hash(name)
    x = (path * 0x9E3779B97F4A7C15 + _NAMES[name]) & 0xFFFFFFFFFFFFFFFF
    x = ((x ^ (x >> 32)) * 0xD6E8FEB86659FD93) & 0xFFFFFFFFFFFFFFFF
    return (x ^ (x >> 32)) - (1 << 63)


def read_runs(page: str) -> tuple[list[tuple[int, int]], list[tuple[str, int, int, int, bool, int]]]:
    """(tags, runs): tags as (token, position); runs as (text, path, block number, dropped, in article, position).

    dropped is 2 inside an element that is never main text, 1 where only a class or id outside the article says so.
    """
    tags: list = []
    runs: list = []
    stack: list[tuple[str, int, bool, int]] = []  # name, dropped, in article, path of open blocks
    opened: Counter = Counter()
    block, at, pos, here = 0, 0, 0, 0

    def text(upto: int) -> None:
        nonlocal here
        if upto > at:
            _, dropped, article, path = stack[-1] if stack else ("", 0, False, 0)
            runs.append((page[at:upto], path, block, dropped, article, here))
            here += 1

    def close(upto: int) -> None:
        opened.subtract(s[0] for s in stack[upto:])
        del stack[upto:]

    while m := _TAG.search(page, pos):
        text(m.start())
        at = pos = m.end()
        name = (m[2] or "").lower()
        if not name:
            continue
        if name in BLOCK:
            block += 1
        elif name == "br" and runs and runs[-1][2] == block:
            runs.append((" ", *runs[-1][1:5], here))
        if m[1]:
            if opened[name]:
                k = len(stack) - 1
                while stack[k][0] != name:
                    k -= 1
                close(k)
                tags.append((_below(stack[-1][3] if stack else 0, "/" + name), here))
                here += 1
            continue
        if name in ENDS_P and opened["p"]:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == "p":
                    close(k)
                    break
                if stack[k][0] in BLOCK:
                    break
        if name in CLOSES and any(opened[n] for n in CLOSES[name]):
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] in CLOSES[name]:
                    close(k)
                    break
                if stack[k][0] in ("ul", "ol", "dl", "table", "select"):
                    break
        _, dropped, article, path = stack[-1] if stack else ("", 0, False, 0)
        token = _below(path, name)
        tags.append((token, here))
        here += 1
        if name in RAW and not m[3].rstrip().endswith("/"):
            end = _END[name].search(page, at)
            at = pos = end.end() if end else len(page)
            continue
        if name in VOID or m[3].rstrip().endswith("/"):
            continue
        noisy = 2 if name in DROPPED else int(name not in ("html", "body") and _noisy(m[3])) * (2 if article else 1)
        if name in ("article", "main"):
            article, noisy = article or not noisy, 2 * bool(noisy)
        stack.append((name, max(dropped, noisy), article, token if name in BLOCK else path))
        opened[name] += 1
    text(len(page))
    return tags, runs


def block_tokens(runs: list) -> list[tuple[int, int, int]]:
    """(token, position, block) of every block's text that an extraction may keep."""
    out: dict[int, list] = {}
    for piece, path, block, dropped, _, k in runs:
        if dropped < 2:
            out.setdefault(block, [path, k, []])[2].append(piece)
    joined = ((path, k, block, " ".join("".join(pieces).split())) for block, (path, k, pieces) in out.items())
    return [(_below(path, "") ^ _hash(text), k, block) for path, k, block, text in joined if text]


def page_tokens(page: str) -> dict[int, list[int]]:
    """Token to [count, first position, last position, 1 for a tag or 0 for text]."""
    tags, runs = read_runs(page)
    found: dict[int, list[int]] = {}
    for token, position, kind in [(t, k, 1) for t, k in tags] + [(t, k, 0) for t, k, _ in block_tokens(runs)]:
        if (seen := found.get(token)) is None:
            found[token] = [1, position, position, kind]
        else:
            seen[0] += 1
            seen[2] = position
    return found


class Template:
    """A host's template: tokens with their class and place, classes with their parent's slot and whether they repeat."""

    def __init__(self, tokens: list[int], classes: list[int], places: list[int], parents: list[int], slots: list[int], once: list[bool]):
        self.tokens = dict(zip(tokens, zip(classes, places)))
        self.parents, self.slots, self.once = parents, slots, once

    def text_blocks(self, tags: list, blocks: list) -> set[int]:
        """Numbers of the blocks whose text is the template's: its tokens in order, each class in its parent's slot."""
        at = [-1] * len(self.parents)
        gone = set()
        for _, token, block in sorted([(k, t, -1) for t, k in tags] + [(k, t, b) for t, k, b in blocks]):
            if (hit := self.tokens.get(token)) is None:
                continue
            c, place = hit
            parent = self.parents[c]
            if (parent < 0 or at[parent] == self.slots[c]) and (place > at[c] or place == 0 and not self.once[c]):
                at[c] = place
                if block >= 0:
                    gone.add(block)
        return gone


def extract(page: str, template: Template | None = None) -> str:
    """Main text of a page: the slots of its template, or all its text without one, inside the article and outside what is not."""
    tags, runs = read_runs(page)
    inside = any(r[4] and r[3] < 2 and not r[0].isspace() for r in runs)
    allowed = 0 if not inside or any(r[4] and not r[3] and not r[0].isspace() for r in runs) else 1  # the article stands in an element named like a sidebar
    gone = template.text_blocks(tags, block_tokens(runs)) if template else ()
    blocks: dict[int, list] = {}
    for piece, _, block, dropped, article, _ in runs:
        if dropped <= allowed and (article or not inside) and block not in gone:
            blocks.setdefault(block, []).append(piece)
    texts = (" ".join(entities.unescape("".join(pieces)).split()) for pieces in blocks.values())
    return "\n".join(t for t in texts if t)


def _host(url) -> F.Column:
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]*)", 1)), F.lit(""))


def _order_and_place(batches):
    """Per host and class: how often each order (a hash in 64 values) and each slot of another class was met."""
    for batch in batches:
        met: dict[tuple, list] = {}
        for host, token, first, last, known, of, once in zip(*(c.to_pylist() for c in batch.columns)):
            place = dict(zip(token, zip(first, last)))
            classes: dict[int, list] = {}
            for t, c, single in zip(known, of, once):
                if t in place:
                    classes.setdefault(c, []).append((*place[t], t, single))
            classes = {c: sorted(x) for c, x in classes.items()}
            for c, found in classes.items():
                order = _hash(" ".join(str(x[2]) for x in found)) & 63
                met.setdefault((host, c, order, None, None), [0, 0])[0] += 1
                low, high = found[0][0], max(x[1] for x in found)
                for p, outer in classes.items():
                    if p != c and all(x[3] for x in outer):
                        k = bisect_left(outer, (low,))
                        if 0 < k < len(outer) and outer[k][0] > high:
                            n = met.setdefault((host, c, None, p, k - 1), [0, 0])
                            n[0] += 1
                            n[1] += outer[k - 1][0]
        rows = [(*key, *n) for key, n in met.items()]
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _MET_ARROW)] if rows else [pa.array([], f.type) for f in _MET_ARROW], schema=_MET_ARROW)


_MET = "host string, class long, order int, parent long, slot int, n long, near long"
_MET_ARROW = pa.schema([("host", pa.string()), ("class", pa.int64()), ("order", pa.int32()), ("parent", pa.int64()), ("slot", pa.int32()), ("n", pa.int64()), ("near", pa.int64())])
_TEMPLATE = "host string, tokens array<long>, classes array<int>, places array<int>, parents array<int>, slots array<int>, once array<boolean>"


def _nested(host: str, rows: list[dict], met: list[dict]) -> dict | None:
    """One template from a host's candidate tokens (token, class, support, at, once) and what its pages say of order and place."""
    members: dict[int, list] = {}
    for r in sorted(rows, key=lambda r: (r["at"], r["token"])):
        members.setdefault(r["class"], []).append(r)
    enough = {c: AGREE * x[0]["support"] for c, x in members.items()}
    valid = [c for c in sorted(members) if max((m["n"] for m in met if m["class"] == c and m["parent"] is None), default=0) >= enough[c]]
    if not valid:
        return None
    number = {c: k for k, c in enumerate(valid)}
    parents, slots = [], []
    for c in valid:
        places = [(m["near"] / m["n"], m["parent"], m["slot"]) for m in met if m["class"] == c and m["parent"] in number and m["n"] >= enough[c]]
        _, parent, slot = max(places, default=(0, None, -1))
        parents.append(number.get(parent, -1))
        slots.append(slot)
    out: dict = {"host": host, "tokens": [], "classes": [], "places": [], "parents": parents, "slots": slots, "once": [all(r["once"] for r in members[c]) for c in valid]}
    for c in valid:
        for place, r in enumerate(members[c]):
            for name, value in (("tokens", r["token"]), ("classes", number[c]), ("places", place)):
                out[name].append(value)
    return out


def templates(pages: DataFrame, min_pages: int = 8, share: float = 0.1) -> DataFrame:
    """(host, tokens, classes, places, parents, slots, once): each host's template, classes numbered from 0."""

    def tokens(batches):
        schema = pa.schema([("host", pa.string()), ("page", pa.int64()), ("token", pa.list_(pa.int64())), *((c, pa.list_(pa.int32())) for c in ("n", "first", "last", "kind"))])
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                hosts, texts = (batch.slice(start, 256).column(i).to_pylist() for i in range(2))
                out: list = [[] for _ in range(7)]
                for host, page in zip(hosts, texts):
                    found = page_tokens(page or "")
                    if not found:
                        continue
                    out[0].append(host)
                    out[1].append(int.from_bytes(hashlib.blake2b(page.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True))
                    out[2].append(list(found))
                    for k in range(4):
                        out[3 + k].append([v[k] for v in found.values()])
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, schema)], schema=schema)

    read = pages.select(_host(F.col("url")).alias("host"), F.col("html").cast("string"))
    busy = stage(read.groupBy("host").agg(F.count("*").alias("c")).where(F.col("c") >= min_pages).select("host"), "html-hosts")
    read = read.join(busy, "host", "left_semi") if busy.count() > 1_000_000 else read.join(F.broadcast(busy), "host", "left_semi")
    read = read.mapInArrow(tokens, "host string, page long, token array<long>, n array<int>, first array<int>, last array<int>, kind array<int>")
    distinct = read.groupBy("host", "page").agg(F.first(F.struct("token", "n", "first", "last", "kind")).alias("t")).select("host", "page", "t.*")
    distinct = stage(distinct, "html-tokens")
    each = distinct.select("host", "page", F.inline(F.arrays_zip("token", "n", "first", "kind")).alias("token", "n", "at", "kind"))
    vector = F.xxhash64("page", "n").cast("decimal(20,0)")
    counted = each.groupBy("host", "token").agg(F.count("*").alias("support"), F.sum(vector).alias("vector"), F.avg("at").alias("at"), F.max("kind").alias("kind"), (F.max("n") == 1).alias("once"))
    sizes = distinct.groupBy("host").agg(F.count("*").alias("pages")).where(F.col("pages") >= min_pages)
    full = counted.where(F.col("support") >= min_pages).join(sizes, "host").where(F.col("support") >= F.col("pages") * share)
    full = full.select("host", "token", F.xxhash64("vector").alias("class"), "support", "at", "kind", "once")
    large = full.groupBy("host", "class").agg(F.count("*").alias("size"), F.max("kind").alias("tags")).where("size >= 2 and tags = 1").select("host", "class")
    full = stage(full.join(large, ["host", "class"]).drop("kind"), "html-classes")
    known = full.groupBy("host").agg(F.collect_list(F.struct("token", "class", "once")).alias("k")).select("host", F.col("k.token").alias("known"), F.col("k.class").alias("of"), F.col("k.once").alias("once"))
    seen = distinct.join(F.broadcast(known) if full.count() <= BROADCAST_TOKENS else known, "host").select("host", "token", "first", "last", "known", "of", "once")
    met = seen.mapInArrow(_order_and_place, _MET).groupBy("host", "class", "order", "parent", "slot").agg(F.sum("n").alias("n"), F.sum("near").alias("near"))

    def nest(key, classes: pa.Table, places: pa.Table) -> pa.Table:
        row = _nested(key[0].as_py(), classes.to_pylist(), places.to_pylist())
        return pa.Table.from_pylist([row] if row else [], schema=schema)

    schema = pa.schema([("host", pa.string()), ("tokens", pa.list_(pa.int64())), *((c, pa.list_(pa.int32())) for c in ("classes", "places", "parents", "slots")), ("once", pa.list_(pa.bool_()))])
    return full.groupBy("host").cogroup(met.groupBy("host")).applyInArrow(nest, _TEMPLATE)


def main_text(pages: DataFrame, min_pages: int = 8, broadcast_tokens: int = BROADCAST_TOKENS) -> DataFrame:
    """(page_id, url, text, n_chars) of every row of pages(page_id, url, html)."""
    found = stage(templates(pages, min_pages), "html-templates")
    names = ["tokens", "classes", "places", "parents", "slots", "once"]
    rows = pages.select("page_id", "url", F.col("html").cast("string").alias("html"), _host(F.col("url")).alias("host"))
    known = found.select(F.col("host").alias("h"), *names)
    small = (found.agg(F.sum(F.size("tokens"))).first()[0] or 0) <= broadcast_tokens
    both = rows.join(F.broadcast(known) if small else known, F.col("host") == F.col("h"), "left").select("page_id", "url", "html", "host", *names)
    kind = pages.schema["page_id"].dataType.simpleString()

    def run(batches):
        made: dict[str, Template | None] = {}
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                texts = []
                hosts = part.column(3).to_pylist()
                for k, html in enumerate(part.column(2).to_pylist()):
                    if hosts[k] not in made:
                        if len(made) > 256:
                            made.clear()
                        parts = [part.column(4 + i)[k].as_py() for i in range(len(names))]
                        made[hosts[k]] = Template(*parts) if parts[0] else None
                    texts.append(extract(html or "", made[hosts[k]]))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return both.mapInArrow(run, f"page_id {kind}, url string, text string, n_chars long")
