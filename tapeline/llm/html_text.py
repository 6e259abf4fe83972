"""Main text of web pages by a recurrent block labeller.

A page is cut into its leaf blocks. Each block becomes a vector of its hashed tag path (tag names
and words of class and id), its hashed words and a few plain measures; a bidirectional LSTM in
numpy reads the sequence in both directions, so that every block is classified with the whole page
as context.

No labels are given, so the network learns from pages whose layout says what is what: a bounded
sample (``SAMPLE_PAGES`` pages of at most ``SAMPLE_CHARS`` characters) gives texts inside and outside
an article, and each sampled page is also laid out anew in other mark-up, with menus, sidebars,
notices, adverts, forms and reader comments around the article. Training takes place on
the driver with a fixed seed; extraction is one narrow pass over all pages.

Defined results: NULL and empty pages give an empty text; script, style, comment and head
content is never text, nor are drawings and templates, but formulas and what objects hold are; a drawing left open ends at
the first element of a page, a template without an end tag is none; a script ends at its own end tag whatever stands in it; a head left open ends at the
first text or element that cannot stand in a head; unclosed tags end with their block; every row gives one row; pages of any
length are read whole (over ``WINDOW`` blocks in overlapping windows).
"""

from __future__ import annotations

import html
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeline.llm.common import bound_batches

PATH_DIM, WORD_DIM, PLAIN_DIM = 96, 32, 6
DIM = PATH_DIM + WORD_DIM + PLAIN_DIM
HIDDEN = 16
SAMPLE_PAGES, SAMPLE_CHARS = 200, 100_000
LAYOUTS = 4
EPOCHS, BATCH, RATE = 8, 32, 0.01
TRAIN_BLOCKS = 160
LONG = 200
WINDOW, CONTEXT = 20_000, 200

# Fixed values of HTML: elements that begin and end blocks, that have no content, and whose content is no text.
BLOCKS = frozenset(
    "address article aside blockquote body br button caption center dd details dialog div dl dt fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 header hgroup hr html label legend li main menu nav ol option p pre section select summary "
    "table tbody td tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style template noscript svg iframe textarea title head".split())
# Elements that end a drawing which was left open, as browsers take them.
NO_DRAWING = frozenset(
    "b big blockquote body br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 hr i img li listing menu nobr ol p pre "
    "ruby s small span strike strong sub sup table tt u ul var".split()
)
# Of the raw ones, those whose content holds no tags and no comments, and what may stand in a head.
PLAIN = frozenset("script style noscript iframe textarea title".split())
HEAD = frozenset("base basefont bgsound link meta noframes noscript script style template title".split())
# Elements whose start ends an open paragraph or an open element of their own kind.
SELF_CLOSING = frozenset("p li dd dt option tr td th".split())

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?>[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>",
    re.S,
)
_END = {name: re.compile(rf"</{name}(?=[\s/>])[^>]*>?", re.I) for name in PLAIN}
_SCRIPT = re.compile(r"<!--|-->|<script(?=[\s/>])|</script(?=[\s/>])[^>]*>?", re.I)
_NAMES = re.compile(r"(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_WORD = re.compile(r"\w+")


@dataclass
class Block:
    """A leaf: its text, tag path and the characters of it that are links."""

    path: tuple[str, ...]
    parts: list[str] = field(default_factory=list)
    linked: int = 0

    @property
    def text(self) -> str:
        return " ".join(html.unescape("".join(self.parts)).split())


def _plain_end(page: str, at: int, name: str) -> int:
    """Where an element of ``PLAIN`` ends whose content begins at ``at``; the end of the page if it stays open."""
    end = _END[name].search(page, at)
    if end is None:
        return len(page)
    if name == "script" and (note := page.find("<!--", at, end.start())) >= 0 and (close := page.find("-->", end.end())) >= 0:
        # A script that is written out inside a comment within a script does not end the outer one.
        noted = inner = False
        for m in _SCRIPT.finditer(page, note, close + 3):
            if m[0] == "<!--":
                noted = True
            elif m[0] == "-->":
                noted = inner = False
            elif m[0][1] != "/":
                inner = noted
            elif inner:
                inner = False
            else:
                return m.end()
        after = _END[name].search(page, close)
        return after.end() if after else end.end()
    return end.end()


def blocks(page: str | None) -> list[Block]:
    """The leaf blocks with text, in page order."""
    if not page:
        return []
    out: list[Block] = []
    stack: list[tuple[str, tuple[str, ...]]] = []
    current: Block | None = None
    at, skip, head, links = 0, None, False, 0
    inside = within = 0  # open elements of the skipped kind, and of embedded pages in a drawing
    last = page.rfind(">")  # behind it there are no tags, only text that looks like them
    ends: dict[str, int] = {}

    def closes(name: str) -> bool:
        """Whether an end tag of ``name`` follows."""
        if name not in ends:
            ends[name] = page.lower().rfind(f"</{name}")
        return ends[name] >= at

    def text(piece: str) -> None:
        nonlocal current
        if current is None:
            if not piece.strip():
                return
            current = Block(tuple(x for _, own in stack for x in own))
            out.append(current)
        current.parts.append(piece)
        current.linked += len(piece) if links else 0

    while at <= last and (m := _TOKEN.search(page, at)):
        if page[at : m.start()].strip():
            head = head and skip is not None  # HTML ends an open head at text
        if m.start() > at and skip is None and not head:
            text(page[at : m.start()])
        at = m.end()
        name = (m[2] or m[5] or "").lower()
        if not name:
            continue
        closing = bool(m[1] or m[4])
        opens = not closing and not (m[3] or m[6] or "").rstrip().endswith("/")
        if opens and name in PLAIN:
            at = _plain_end(page, at, name)
            continue
        if skip is not None:
            if name == skip:
                inside += 1 if opens else -1 if closing else 0
                skip = skip if inside else None
                continue
            if name == "foreignobject":
                within += 1 if opens else -1 if closing else 0
            if skip != "svg" or within > 0 or closing or name not in NO_DRAWING:
                continue
            skip = None  # the drawing ends here, and the element counts
        if name == "head":
            head = opens
            continue
        # An open head also ends at the first element that cannot stand in it.
        head = head and (name in HEAD or closing and name not in ("body", "html"))
        if name in RAW:
            if opens and name not in PLAIN and closes(name):
                skip, inside, within = name, 1, 0
            continue
        if name == "a":
            links = 0 if closing else 1
        if name in BLOCKS:
            current = None
        if closing:
            for depth in range(len(stack) - 1, -1, -1):
                if stack[depth][0] == name:
                    del stack[depth:]
                    break
        elif name not in VOID:
            if name in BLOCKS:
                # Inline elements and paragraphs that were left open end here.
                while stack and (stack[-1][0] not in BLOCKS or stack[-1][0] == "p" or stack[-1][0] == name and name in SELF_CLOSING):
                    stack.pop()
            words = [w.lower() for g in _NAMES.findall(m[3] or m[6] or "") for w in _WORD.findall(" ".join(g))]
            stack.append((name, (name, *(f".{w}" for w in words))))
    rest = page[at:].partition("<!--")[0]  # a comment that stays open reaches to the end
    if rest and skip is None and (not head or rest.strip()):
        text(rest)
    return [b for b in out if b.text]


def _bucket(word: str, size: int) -> tuple[int, float]:
    h = zlib.crc32(word.encode("utf-8", "surrogatepass"))
    return (h >> 1) % size, 1.0 if h & 1 else -1.0


_path_cache: dict[tuple[str, ...], np.ndarray] = {}


def _path_vector(path: tuple[str, ...]) -> np.ndarray:
    if path not in _path_cache:
        if len(_path_cache) > 20_000:
            _path_cache.clear()
        v = np.zeros(PATH_DIM, np.float32)
        for step in dict.fromkeys(path):
            i, sign = _bucket(step, PATH_DIM)
            v[i] += sign
        _path_cache[path] = v
    return _path_cache[path]


def features(page: list[Block], texts: list[str]) -> np.ndarray:
    """One vector per block."""
    out = np.zeros((len(page), DIM), np.float32)
    for row, block, text in zip(out, page, texts):
        row[:PATH_DIM] = _path_vector(block.path)
        words = text.lower().split()
        for w, n in Counter(words).items():
            i, sign = _bucket(w, WORD_DIM)
            row[PATH_DIM + i] += sign * n
        # Frequent words add up with the length: from LONG words on the measure is their mean, so that long blocks look like others.
        row[PATH_DIM : PATH_DIM + WORD_DIM] /= 3.0 * max(1.0, np.sqrt(len(words)), len(words) / np.sqrt(LONG))
        ends = sum(text.count(c) for c in ".,;!?")
        row[-PLAIN_DIM:] = (
            np.log1p(len(text)) / 5, np.log1p(len(words)) / 4, block.linked / (len(text) + block.linked + 1) * 2,
            ends / (len(words) + 1), float("a" in block.path), float(any(re.fullmatch("h[1-6]", p) for p in block.path)),
        )
    return out


class Labeller:
    """A bidirectional LSTM with one sigmoid output per block."""

    def __init__(self, seed: int = 11):
        rng = np.random.default_rng(seed)
        self.p = {"v": rng.normal(0, 0.1, 2 * HIDDEN), "c": np.zeros(1)}
        for d in "fb":
            self.p[f"W{d}"] = rng.normal(0, 0.1, (DIM, 4 * HIDDEN))
            self.p[f"U{d}"] = rng.normal(0, 0.1, (HIDDEN, 4 * HIDDEN))
            self.p[f"b{d}"] = np.zeros(4 * HIDDEN)
            self.p[f"b{d}"][HIDDEN : 2 * HIDDEN] = 1.0
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}

    def _pass(self, x: np.ndarray, mask: np.ndarray, d: str) -> tuple[np.ndarray, list]:
        """States over time (time, page, unit) and what the way back needs."""
        steps = range(len(x)) if d == "f" else range(len(x) - 1, -1, -1)
        z = x @ self.p[f"W{d}"] + self.p[f"b{d}"]
        h = c = np.zeros((x.shape[1], HIDDEN), np.float32)
        states, tape = np.zeros((*x.shape[:2], HIDDEN), np.float32), []
        for t in steps:
            a = z[t] + h @ self.p[f"U{d}"]
            gates = 1 / (1 + np.exp(-np.clip(a[:, : 3 * HIDDEN], -30, 30)))
            i, f, o = gates[:, :HIDDEN], gates[:, HIDDEN : 2 * HIDDEN], gates[:, 2 * HIDDEN :]
            g = np.tanh(a[:, 3 * HIDDEN :])
            m = mask[t][:, None]
            new = f * c + i * g
            shown = np.tanh(new)
            tape.append((t, i, f, o, g, c, h, shown, m))
            c, h = m * new + (1 - m) * c, m * (o * shown) + (1 - m) * h
            states[t] = h
        return states, tape

    def forward(self, x: np.ndarray, mask: np.ndarray):
        (hf, tf), (hb, tb) = self._pass(x, mask, "f"), self._pass(x, mask, "b")
        both = np.concatenate([hf, hb], axis=2)
        return 1 / (1 + np.exp(-np.clip(both @ self.p["v"] + self.p["c"], -30, 30))), both, tf, tb

    def gradients(self, x: np.ndarray, mask: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean cross entropy over the real blocks, and its gradients."""
        p, both, tf, tb = self.forward(x, mask)
        n = mask.sum()
        loss = -(mask * np.log(np.where(y > 0.5, p, 1 - p) + 1e-9)).sum() / n
        e = (p - y) * mask / n
        grads = {"v": (both * e[:, :, None]).sum((0, 1)), "c": np.array([e.sum()])}
        for d, tape, own in (("f", tf, slice(0, HIDDEN)), ("b", tb, slice(HIDDEN, None))):
            dz = np.zeros((*x.shape[:2], 4 * HIDDEN), np.float32)
            out = e[:, :, None] * self.p["v"][own]
            dh = dc = np.zeros((x.shape[1], HIDDEN), np.float32)
            du = np.zeros_like(self.p[f"U{d}"])
            for t, i, f, o, g, c, h, shown, m in reversed(tape):
                total = dh + out[t]
                real = total * m
                dnew = dc * m + real * o * (1 - shown * shown)
                da = np.concatenate([
                    dnew * g * i * (1 - i), dnew * c * f * (1 - f), real * shown * o * (1 - o), dnew * i * (1 - g * g),
                ], axis=1)
                dz[t] = da
                du += h.T @ da
                dh = total * (1 - m) + da @ self.p[f"U{d}"].T
                dc = dc * (1 - m) + dnew * f
            grads[f"U{d}"], grads[f"b{d}"] = du, dz.sum((0, 1))
            grads[f"W{d}"] = x.reshape(-1, DIM).T @ dz.reshape(-1, 4 * HIDDEN)
        return float(loss), grads

    def fit(self, pages: list[tuple[np.ndarray, np.ndarray]], seed: int = 5) -> float:
        """Adam over batches of pages with like numbers of blocks; returns the last epoch's loss."""
        rng = np.random.default_rng(seed)
        order = sorted(range(len(pages)), key=lambda i: len(pages[i][0]))
        batches = [_stack([pages[i] for i in order[a : a + BATCH]]) for a in range(0, len(order), BATCH)]
        moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in self.p.items()}
        step, loss = 0, 0.0
        for _ in range(EPOCHS):
            losses = []
            for k in rng.permutation(len(batches)):
                loss, grads = self.gradients(*batches[k])
                losses.append(loss)
                step += 1
                for name, g in grads.items():
                    a, b = moments[name]
                    a += 0.1 * (g - a)
                    b += 0.001 * (g * g - b)
                    self.p[name] -= (RATE * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
            loss = float(np.mean(losses))
        return loss

    def label(self, pages: list[np.ndarray]) -> list[np.ndarray]:
        """Which blocks are main text, for pages of any length."""
        out: list[np.ndarray] = [np.zeros(len(p), bool) for p in pages]
        parts = [
            (i, a, max(0, a - CONTEXT), min(len(p), a + WINDOW + CONTEXT))
            for i, p in enumerate(pages) for a in range(0, len(p), WINDOW)
        ]
        parts.sort(key=lambda x: x[3] - x[2])
        begin = 0
        while begin < len(parts):
            end = begin + 1
            while end < len(parts) and end - begin < 64 and (parts[end][3] - parts[end][2]) * (end + 1 - begin) <= WINDOW:
                end += 1
            group = parts[begin:end]
            x, mask, _ = _stack([(pages[i][low:high], np.zeros(high - low)) for i, _, low, high in group])
            p = self.forward(x, mask)[0]
            for column, (i, a, low, high) in enumerate(group):
                stop = min(a + WINDOW, len(pages[i]))
                out[i][a:stop] = p[a - low : stop - low, column] > 0.5
            begin = end
        return out


def _stack(pages: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    longest = max(len(x) for x, _ in pages)
    x = np.zeros((longest, len(pages), DIM), np.float32)
    mask, y = np.zeros((longest, len(pages)), np.float32), np.zeros((longest, len(pages)), np.float32)
    for i, (own, target) in enumerate(pages):
        x[: len(own), i], mask[: len(own), i], y[: len(own), i] = own, 1, target
    return x, mask, y


# The words of tags, classes and ids that tell main text from the rest.
MAIN = frozenset("article main .article .content .entry .post .story .main .body .text".split())
OTHER = frozenset(
    "nav header footer aside form button select menu dialog label .ad .ads .advert .advertisement .banner .breadcrumb .comment "
    ".comments .cookie .disqus .footer .header .menu .nav .navbar .newsletter .notice .pagination .popup .promo .related .reply "
    ".respond .share .sidebar .social .sponsor .subscribe .toolbar .widget".split()
)


def told(block: Block) -> float | None:
    """The label that the layout itself gives, if any."""
    if OTHER.intersection(block.path):
        return 0.0
    return 1.0 if MAIN.intersection(block.path) else None


_SHELLS = (
    "<article>{}</article>", "<main>{}</main>", "<main><article>{}</article></main>", '<div class="content">{}</div>',
    '<div id="main-content"><div class="post-body">{}</div></div>', '<section class="article-text">{}</section>',
    '<div class="page"><div class="entry-content">{}</div></div>', '<div id="content"><div class="story">{}</div></div>',
    "<div><div>{}</div></div>", "<section>{}</section>",
)
_LINES = ("<p>{}</p>", "<p>{}<br>", "<div>{}</div>", "<p><b>{}</b></p>", "<p><i>{}", "<blockquote>{}</blockquote>", "<h2>{}</h2>", "<ul><li>{}</li></ul>")
_BEFORE = (
    "<nav><ul>{links}</ul></nav>", '<header><h2>{text}</h2></header>', '<div class="menu">{links}</div>', '<div class="cookie-notice"><p>{text}</p></div>',
    '<div class="ad">{text}</div>', '<div class="banner">{text}</div>', '<ul class="breadcrumb">{links}</ul>', '<div id="header"><p>{text}</p></div>',
    '<aside class="sidebar"><h3>{text}</h3><ul>{links}</ul></aside>', '<div class="notice">{text}</div>', '<form><label>{text}</label><input><button>{text}</button></form>',
)
_AFTER = (
    "<footer>{text}</footer>", '<section class="comments"><h3>{text}</h3><div class="comment"><p>{text}</p></div><div class="comment"><p>{text}</p><p>{text}</p></div></section>',
    '<div id="comments"><ul><li class="comment"><p>{text}</p></li><li class="comment"><p>{text}</p></li></ul></div>', '<div class="related"><ul>{links}</ul></div>',
    '<div class="sidebar"><p>{text}</p><ul>{links}</ul></div>', '<div class="ads"><p>{text}</p></div>', '<div class="share">{links}</div>',
    '<form class="newsletter"><p>{text}</p><input></form>', '<div id="footer"><p>{text}</p></div>', '<aside><p>{text}</p></aside>',
)


def laid_out(main: list[str], other: list[str], rng: np.random.Generator) -> tuple[str, list[float]]:
    """A new page around the texts ``main``; the labels of its blocks follow from a marker character."""
    pick = lambda options: options[int(rng.integers(len(options)))]
    some = lambda: html.escape(pick(main) if rng.random() < 0.5 or not other else pick(other))[:600]
    links = lambda: "".join(f'<li><a href="/x">{html.escape(pick(other or main))[:40]}</a></li>' for _ in range(int(rng.integers(2, 7))))

    def furniture(forms: tuple[str, ...]) -> str:
        chosen = [forms[i] for i in rng.permutation(len(forms))[: int(rng.integers(1, 5))]]
        return "".join(re.sub(r"\{(text|links)\}", lambda m: some() if m[1] == "text" else links(), f) for f in chosen)

    mark = "\ue000"  # a private character
    inner = "".join((pick(_LINES) if rng.random() < 0.3 else _LINES[0]).format(mark + html.escape(t)) for t in main)
    inside = furniture(_BEFORE) if rng.random() < 0.2 else ""
    page = f"<html><body>{furniture(_BEFORE)}{pick(_SHELLS).format('<h1>' + mark + html.escape(main[0])[:80] + '</h1>' + inside + inner)}{furniture(_AFTER)}</body></html>"
    labels = [float(mark in b.text) for b in blocks(page)]
    return page.replace(mark, ""), labels


def train(pages: list[str], seed: int = 3) -> Labeller:
    """A labeller from sampled pages."""
    rng = np.random.default_rng(seed)
    examples: list[tuple[np.ndarray, np.ndarray]] = []
    for page in pages:
        found = blocks(page)[:TRAIN_BLOCKS]
        labels = [told(b) for b in found]
        texts = [b.text for b in found]
        main = [t for t, y in zip(texts, labels) if y == 1.0]
        other = [t for t, y in zip(texts, labels) if y == 0.0]
        if not main:
            continue
        if None not in labels:
            examples.append((features(found, texts), np.array(labels, np.float32)))
        for _ in range(LAYOUTS):
            size = int(rng.integers(1, min(len(main), 12) + 1))
            new, own = laid_out(main[:size], other, rng)
            parsed = blocks(new)
            if len(parsed) == len(own):
                examples.append((features(parsed, [b.text for b in parsed]), np.array(own, np.float32)))
    model = Labeller()
    if not examples:
        # No page tells its article: learn from invented layouts of plain words.
        words = "one two three four five six seven eight nine ten".split()
        for _ in range(64):
            main = [" ".join(rng.choice(words, int(rng.integers(5, 60)))) + "." for _ in range(int(rng.integers(1, 8)))]
            new, own = laid_out(main, ["home", "about us", "all rights reserved"], rng)
            parsed = blocks(new)
            if len(parsed) == len(own):
                examples.append((features(parsed, [b.text for b in parsed]), np.array(own, np.float32)))
    model.fit(examples)
    return model


def extract(pages: DataFrame, model: Labeller) -> DataFrame:
    """``page_id``, ``url``, ``text`` and ``n_chars`` of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, len(batch), 256):
                part = batch.slice(a, 256)
                found = [blocks(h) for h in part.column(2).to_pylist()]
                texts = [[b.text for b in page] for page in found]
                labels = model.label([features(page, own) for page, own in zip(found, texts)])
                out = [" ".join(t for t, y in zip(own, keep) if y) for own, keep in zip(texts, labels)]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(out, pa.string()), pa.array([len(t) for t in out], pa.int64())],
                    ["page_id", "url", "text", "n_chars"],
                )

    # Ids pass through as they are: NULL and large ones would not survive pandas.
    rows = bound_batches(pages).select(F.col("page_id").cast("long"), "url", "html")
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")


def fit_labeller(pages: DataFrame) -> Labeller:
    """Train on a bounded sample, the pages with the smallest hashes of their id."""
    usable = pages.where(F.length("html").between(1, SAMPLE_CHARS))
    sample = usable.select("page_id", "html").orderBy(F.xxhash64("page_id", "html")).limit(SAMPLE_PAGES)
    return train([r["html"] for r in sample.collect()])


def op6_html_text(spark, sf_dir: str) -> DataFrame:
    """The main text of every page of ``pages``."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return extract(pages, fit_labeller(pages))
