"""Text quality statistics and the form of documents (problem 9).

A text is cut into segments - paragraphs, split where lines change between rows
of cells, marked items and other lines - and each segment gets statistics: words
per line, word length, symbols, line ends, common words, digits, marks, regular
cells, repetition, vocabulary, longest token, foreign characters, plausible and
capitalised words.  A Gaussian mixture is fitted by expectation-maximisation on
the standardised statistics of the leading segments of all documents and of
``inspected_examples`` (made by rule), among which it starts.  Components are mapped to
prose, list, table or junk by the majority of the inspected segments - all documents
labelled by hand and the examples - that they explain, so single wrong labels do not matter.  Every segment of every
document is then assigned, and a document has the form of more than half of its
characters.

Documents are read in one pass without a shuffle; their statistics are kept.  The
model has a fixed size, and a round of the fit is one pass over the statistics of the
leading segments: each partition gives its sums, which have the size of the model.

Defined results
    * null, empty and blank texts are junk (nearly empty);
    * characters are counted without white space at line ends and blank lines;
      code between fences counts as prose; without a majority a text is prose;
    * repeated doc_ids are reported once; documents that are labelled twice or
      with unknown labels give one vote for each known label.
"""

from __future__ import annotations

import math
import random
import re
from collections import Counter
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanforge.session import cut

KINDS = ("prose", "list", "table", "junk")
COMPONENTS = 64
PIECE = 120  # words
SHINGLE = 8  # words
SEED = 11

# Common words of English, German, French, Spanish, Italian, Portuguese and Dutch.
COMMON = frozenset(
    """the a an of to and in is that for it with not as was be on by when before after which each more than one or but if its this there our we you have has had so at from are were what most both my can could
    would should will may might must do did does no nor only nothing else until while because although
    der die das und ist nicht ein eine einen einem wir den dem des mit für auf wenn dann von zu im es sie er als auch wird aber man kann bei noch
    le la les une un est pas pour dans et que quand elle il du au ce qui sur avec nous nouvelle
    el los las una en y con cuando ella hay para por del se lo nos pero si sin más muy como a al su
    di che non per sono della il nel ma ho os das uma não com na em da mas het een van niet op de te voor want zijn""".split()
)
_MARKED = re.compile(r"^\s*(?:[-*+•‣◦▪–]\s|\(?\d{1,3}[.)]\s|\(?[A-Za-z][.)]\s|\[[ xX]\]\s|(?:TODO|DONE):?\s)")
_GAP = re.compile(r"\S(?: {2,}|\t)(?=\S)")
_CELL_TAG = re.compile(r"<t[dhr]\b|</t[dhr]>", re.I)
_RULE = re.compile(r"^\s*[|+:\-=\s]{5,}$")
_STAMP = re.compile(r"\d\d:\d\d:\d\d|^[0-9a-f]{6,}\s|\b\d{1,3}%\s*$|\b0x[0-9a-f]{4,}|:\d+:\d+\)?$")
_VERSION = re.compile(r"[=@~^]=?\s?v?\d+\.\d|\bin \.{0,2}/?\w+/\S+$")
_LETTERS = re.compile(r"[^\W\d_]+")
_END = (".", "!", "?", ":", ";", "…", "。", '."', '!"', '?"', ".)", "?)", ".'")
_VOWEL = set("aeiouyäöüáéíóúàèìòùâêîôûæøåœ")


def line_shape(line: str) -> str:
    """h, p, t, f, c: a row of cells by tags, pipes, tabs, gaps, commas; m: a marked item; o: other."""
    if "<" in line and (_CELL_TAG.search(line) or line.strip().lower() in ("<table>", "</table>", "<tbody>", "</tbody>", "<thead>", "</thead>")):
        return "h"
    if line.count("|") >= 2 or (_RULE.match(line) and ("|" in line or "+" in line)):
        return "p"
    if "\t" in line.strip():
        return "t"
    if _MARKED.match(line):
        return "m"
    gaps = len(_GAP.findall(line)) if "  " in line else 0
    if gaps and len(line.split()) <= 3 * (gaps + 1):
        return "f"
    for d in ",;":
        if line.count(d) >= 2 and len(line.split()) <= line.count(d) + 2 and not line.rstrip().endswith((".", "!", "?")):
            return "c"
    return "o"


def segments(text: str) -> list[tuple[str, list[str]]]:
    """(kind of segment, lines): kind ``code`` between fences, else ``text``."""
    out: list[tuple[str, list[str]]] = []
    fenced, lines, last = False, [], ""

    def flush() -> None:
        nonlocal lines
        if lines:
            out.append(("code" if fenced else "text", lines))
        lines = []

    for raw in re.split(r"\r\n|\r|\n|\u2028|\x0b|\x0c", text):
        line = raw.rstrip()
        if line.lstrip().startswith(("```", "~~~")) and line.strip("`~ \t").isalnum() | (line.strip("`~ \t") == ""):
            flush()
            fenced, last = not fenced, ""
            continue
        if not line.strip():
            flush()
            last = ""
            continue
        shape = "" if fenced else line_shape(line)
        if lines and shape != last and not (last == "m" and line[:1] in " \t" and shape in "ofc"):
            flush()
        lines.append(line)
        last = shape if not (last == "m" and line[:1] in " \t" and shape in "ofc" and len(lines) > 1) else "m"
    flush()
    # rows of an aligned table may have a single cell; short other lines between rows belong to them
    merged: list[tuple[str, list[str]]] = []
    shapes = [line_shape(x[0]) if k == "text" else "" for k, x in out]
    i = 0
    while i < len(out):
        kind, lines = out[i]
        while i + 2 < len(out) and kind == "text" and shapes[i] in ("f", "c", "t") and shapes[i + 2] == shapes[i] and shapes[i + 1] == "o" and max(len(x.split()) for x in out[i + 1][1]) <= 2 and len(out[i + 1][1]) <= 2:
            lines = lines + out[i + 1][1] + out[i + 2][1]
            shapes[i + 2] = shapes[i]
            i += 2
        if i + 1 < len(out) and kind == "text" and shapes[i] in ("f", "c", "t") and shapes[i + 1] == "o" and max(len(x.split()) for x in out[i + 1][1]) <= 1 and len(out[i + 1][1]) <= 2:
            lines = lines + out[i + 1][1]
            i += 1
        merged.append((kind, lines))
        i += 1
    return merged


@lru_cache(maxsize=200_000)
def _plausible(token: str) -> bool:
    """Whether a token reads like a word."""
    p = token.strip(".,;:!?\"'()[]*_`#>")
    if not p or len(p) > 24 or not p.replace("-", "").replace("'", "").replace("_", "").isalpha():
        return False
    return len(p) < 4 or 0.15 <= sum(c in _VOWEL for c in p.lower()) / len(p) <= 0.75


FEATURES = ("words_per_line", "word_length", "symbols", "line_ends", "common", "digits", "marks", "cells", "repeats", "vocabulary", "longest", "foreign", "plausible", "capitals", "tiny", "stamps", "versions", "short_lines")


def statistics(lines: list[str]) -> list[float]:
    """The statistics of a segment, in the order of ``FEATURES``."""
    text = "\n".join(lines)
    n = len(text)
    tokens = text.split()
    words = [w.lower() for w in _LETTERS.findall(text)]
    nw, nt, nl = max(1, len(words)), max(1, len(tokens)), len(lines)
    letters = sum(map(len, words))
    spaces = n - sum(map(len, tokens))
    digits = sum(map(text.count, "0123456789")) if text.isascii() else sum(c.isdigit() for c in text)
    symbols = n - letters - spaces - digits
    ends = sum(x.rstrip("*_`\"') ").endswith((".", "!", "?", ":", ";", "…")) for x in lines)
    common = sum(w in COMMON for w in words)
    marks = sum(1 for x in lines if _MARKED.match(x))
    best = 0.0
    if nl >= 2:
        for count in (
            [x.count("|") for x in lines], [x.count("\t") for x in lines], [x.count(",") for x in lines], [x.count(";") for x in lines],
            [len(_CELL_TAG.findall(x)) for x in lines] if "<" in text else [], [len(_GAP.findall(x)) for x in lines] if "  " in text or "\t" in text else [],
        ):
            some = [c for c in count if c]
            if some:
                best = max(best, Counter(some).most_common(1)[0][1] / nl if len(set(some)) <= 3 else 0.7 * len(some) / nl)
    # repetition and vocabulary are means over pieces of the text, so that they do not grow with its length
    starts = range(0, max(1, len(words) - PIECE // 2), PIECE)
    pieces = [words[i : i + PIECE] if i != starts[-1] else words[i:] for i in starts]
    shares = [1 - len(set(g)) / len(g) for p in pieces if (g := list(zip(p, p[1:], p[2:], strict=False)))]
    repeats = sum(shares) / len(shares) if shares else 0.0
    if nl >= 3:
        repeats = max(repeats, 1 - len({re.sub(r"\d+", "0", x.strip()) for x in lines}) / nl)
    vocabulary = sum(math.log(len(set(p)) + 1) / math.log(len(p) + 1) if len(p) > 3 else 1.0 for p in pieces) / len(pieces)
    plausible = sum(map(_plausible, tokens)) / nt
    capitals = sum(1 for t in tokens if t[:1].isupper()) / nt
    foreign = 0.0 if text.isascii() else (n - len(text.encode("ascii", "ignore"))) / max(1, n)
    stamps = sum(1 for x in lines if _STAMP.search(x)) / nl
    versions = sum(1 for x in lines if _VERSION.search(x)) / nl
    short = sum(1 for x in lines if len(x.split()) <= 8 and not x.rstrip().endswith((".", "!", "?", ",", "…"))) / nl if nl > 1 else 0.0
    return [
        math.log1p(min(nt / nl, 120)), min(15.0, letters / nw), symbols / max(1, n), ends / nl, common / nw if words else 0.0, digits / max(1, n), marks / nl, best, repeats, vocabulary,
        math.log1p(max((len(t) for t in tokens), default=0)), foreign, plausible, capitals, math.log1p(min(n, 40)), stamps, versions, short,
    ]


def inspected_examples(seed: int = SEED, each: int = 30) -> list[tuple[str, str]]:
    """(kind, text) in many notations, made by rule: the inspected examples of the mapping."""
    r = random.Random(seed)
    # Words the examples are made of.
    nouns = "engine river market basket garden window letter station carpet harbour village picture teacher bridge lesson morning kitchen doctor history forest number weather island table minute parser cursor module".split()
    verbs = "opens keeps follows carries repairs reaches changes answers paints measures moves closes sorts reads writes".split()
    adjs = "quiet small early narrow distant yellow heavy careful simple wooden broken local empty modern".split()
    pick = r.choice

    def sentence() -> str:
        forms = [
            f"The {pick(adjs)} {pick(nouns)} {pick(verbs)} the {pick(nouns)} before the {pick(nouns)} {pick(verbs)} it.",
            f"When a {pick(nouns)} {pick(verbs)} there is nothing that we could do for the {pick(adjs)} {pick(nouns)}.",
            f"It was the {pick(nouns)} and not the {pick(nouns)} which they had in mind, so we kept both.",
            f"I think that each {pick(nouns)} in this {pick(nouns)} will need a {pick(adjs)} {pick(nouns)}!",
            f"Gestern haben wir den {pick(nouns)} und das {pick(nouns)} in die Stadt gebracht, obwohl es zu spät für sie war.",
            f"Man kann mit einem {pick(nouns)} nicht alles machen, aber der {pick(nouns)} ist auf dem Tisch.",
            f"Er sagt, dass die {pick(nouns)} von heute noch bei ihm im Haus ist und nicht bei uns.",
            f"Les enfants ont mis le {pick(nouns)} sur la table et ils sont partis avec du pain pour le {pick(nouns)}.",
            f"On ne sait pas si ce {pick(nouns)} est au bord de la mer ou dans un {pick(nouns)}.",
            f"Ayer los vecinos trajeron el {pick(nouns)} por la calle, pero no se lo dieron a nadie del {pick(nouns)}.",
            f"Si no llega la {pick(nouns)} antes de las ocho, nos vamos sin ella con el {pick(nouns)}.",
            f"Il {pick(nouns)} che abbiamo visto non è per la casa di mio padre, ma per il {pick(nouns)} della scuola.",
            f"O {pick(nouns)} da minha rua não abre aos domingos, mas uma {pick(nouns)} nos espera em casa.",
            f"Het {pick(nouns)} van de buren staat niet op de kaart, want een {pick(nouns)} is te groot voor ons.",
        ]
        return pick(forms[:4]) if r.random() < 0.7 else pick(forms[4:])

    def short() -> str:
        return " ".join(pick(adjs + nouns) for _ in range(r.randint(1, 5)))

    def cell() -> str:
        return pick([pick(nouns), pick(adjs), str(r.randint(1, 9999)), f"{r.random():.3f}", f"{pick(nouns)}_{pick(nouns)}", ""])

    def path() -> str:
        return f"{pick(verbs)} {pick(nouns)}_{pick(nouns)} in /{pick(nouns)}/{pick(nouns)}/{pick(nouns)}.{pick(['py', 'go', 'md', 'js'])}"

    def grid() -> list[list[str]]:
        w = r.randint(3, 6)
        return [[cell() if i else pick(nouns + adjs) for _ in range(w)] for i in range(r.randint(5, 22))]

    def wrap(t: str, width: int) -> str:
        out, line = [], ""
        for w in t.split():
            if len(line) + len(w) > width and line:
                out.append(line)
                line = ""
            line = f"{line} {w}".strip()
        return "\n".join([*out, line])

    out: list[tuple[str, str]] = []
    for _ in range(each):
        many = [sentence() for _ in range(r.randint(1, 7))]
        out += [("prose", " ".join(many)), ("prose", many[0]), ("prose", wrap(" ".join(many), r.randint(40, 75))), ("prose", "\n".join("> " + x for x in wrap(" ".join(many), 60).split("\n")))]
        out += [("prose", " ".join(many).lower().replace(",", "").replace(".", "")), ("prose", " ".join(many).upper()), ("prose", wrap(" ".join(many).lower(), 60)), ("prose", "# " + short().capitalize() + "\n" + " ".join(many)), ("prose", " ".join(many).replace(" the ", "  the ")), ("prose", " ".join(many).replace(" ", "\u00a0"))]
        items = r.randint(4, 20)
        for mark in (lambda i: "- ", lambda i: "* ", lambda i: "+ ", lambda i: "• ", lambda i: f"{i + 1}. ", lambda i: f"{chr(97 + i % 26)}) ", lambda i: "- [ ] ", lambda i: "  - " if i % 3 == 1 else "- "):
            body = pick([short, short, path, sentence])
            out.append(("list", "\n".join(mark(i) + (body() if r.random() < 0.8 else pick([short, path])()) for i in range(items))))
        for body in (short, path, lambda: f"{pick(nouns)}-{pick(nouns)}=={r.randint(0, 9)}.{r.randint(0, 30)}.{r.randint(0, 9)}", lambda: pick([short, path])()):
            out.append(("list", "\n".join(body() for _ in range(items))))
            out.append(("list", pick(["## Changes", "Unreleased", "Open points", "Steps"]) + "\n" + "\n".join(body() for _ in range(items))))
        for fmt in (
            lambda g: "\n".join(",".join(x) for x in g), lambda g: "\n".join("\t".join(x) for x in g), lambda g: "\n".join(";".join(x) for x in g),
            lambda g: "\n".join(["| " + " | ".join(g[0]) + " |", "|" + "---|" * len(g[0])] + ["| " + " | ".join(x) + " |" for x in g[1:]]),
            lambda g: "\n".join("".join(f"{c:<22}" for c in x).rstrip() or x[0] for x in g),
            lambda g: "\n".join(["<table>"] + ["<tr>" + "".join(f"<td>{c}</td>" for c in x) + "</tr>" for x in g] + ["</table>"]),
            lambda g: "\n".join(y for x in g for y in ("+" + ("-" * 14 + "+") * len(x), "|" + "".join(f"{c:<14}|" for c in x))),
        ):
            out.append(("table", fmt(grid())))
        alphabet = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/"
        rand = lambda k, a=alphabet: "".join(pick(a) for _ in range(k))
        menu = ["Home", "Search", "Menu", "Back", "Next", "Sign in", "Docs", "Share", "Pricing", "Accept cookies", "Login", "About"]
        s = sentence()
        out += [
            ("junk", rand(r.randint(200, 1500))), ("junk", "\n".join(rand(76) for _ in range(r.randint(3, 15)))), ("junk", " ".join(pick(menu) for _ in range(r.randint(15, 80)))), ("junk", "\n".join(pick(menu) for _ in range(r.randint(8, 30)))),
            ("junk", "\n".join([s] * r.randint(5, 25))), ("junk", " ".join([s] * r.randint(5, 25))), ("junk", " ".join([pick(nouns)] * r.randint(30, 150))),
            ("junk", "".join(pick("©€¿™ÂÃâ\ufffd ") for _ in range(r.randint(60, 300)))), ("junk", " ".join(pick("#$%&*+-<=>@^_{}~!()") * r.randint(1, 9) for _ in range(r.randint(20, 60)))),
            ("junk", " ".join("".join(pick("abcdefghijklmnopqrstuvwxyz;,./[]") for _ in range(r.randint(2, 11))) for _ in range(r.randint(25, 120)))),
            ("junk", "".join(f"function {rand(2, alphabet[:52])}({pick('abcdef')}){{return {rand(1)}[{r.randint(1, 99)}]||{rand(2)}&&!0}}" for _ in range(r.randint(5, 30)))),
            ("junk", "\n".join(f"[{'#' * i}{'.' * (40 - i)}] {i * 5 // 2}%" for i in range(0, 41, r.randint(2, 5)))),
            ("junk", "\n".join(f"{i * 16:08x}  " + " ".join(rand(2, "0123456789abcdef") for _ in range(16)) for i in range(r.randint(6, 30)))),
            ("junk", "\n".join(f"2024-{r.randint(1, 12):02d}-{r.randint(1, 28):02d}T{r.randint(0, 23):02d}:{r.randint(0, 59):02d}:{r.randint(0, 59):02d}Z {pick(['INFO', 'WARN', 'DEBUG', 'ERROR'])} [{rand(6, '0123456789abcdef')}] {pick(nouns)}_{pick(nouns)}={r.randint(1, 9999)} {pick(nouns)}={rand(8, '0123456789abcdef')}" for _ in range(r.randint(4, 20)))),
            ("junk", pick(["null", "[object Object]", "...", "undefined", "NaN", "-", "ok", "n/a", "{}", "[]", "TODO", "None"])), ("junk", pick("abcxyz.-#!")),
            ("junk", "\n".join(f"  at {pick(nouns)}.{pick(verbs)} ({pick(nouns)}.js:{r.randint(1, 999)}:{r.randint(1, 99)})" for _ in range(r.randint(4, 15)))),
        ]
    return out


class Mixture:
    """A Gaussian mixture with diagonal covariances on standardised statistics, its components mapped to kinds."""

    def __init__(self, mean, scale, weights, centres, variances, kinds):
        self.mean, self.scale, self.weights, self.centres, self.variances, self.kinds = mean, scale, weights, centres, variances, kinds

    def _log(self, z: np.ndarray) -> np.ndarray:
        inv = 1 / self.variances
        d = (z * z) @ inv.T - 2 * (z @ (self.centres * inv).T) + (self.centres**2 * inv).sum(1)[None]
        return np.log(self.weights)[None] - 0.5 * (d + np.log(self.variances).sum(1)[None])

    def responsibilities(self, x: np.ndarray) -> np.ndarray:
        log = self._log((x - self.mean) / self.scale)
        log -= log.max(1, keepdims=True)
        p = np.exp(log)
        return p / p.sum(1, keepdims=True)

    def predict(self, x: np.ndarray) -> np.ndarray:
        """Index into ``KINDS`` for each row."""
        return (self.responsibilities(x) @ self.kinds).argmax(1)


Totals = Callable[[Callable[[np.ndarray, np.ndarray], np.ndarray]], np.ndarray]


def _moments(x: np.ndarray, _: np.ndarray) -> np.ndarray:
    return np.concatenate([[len(x)], x.sum(0), (x**2).sum(0)])


def _expected(m: Mixture) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    """The sums of a round of EM: responsibilities, these times statistics and their squares, log-likelihood."""

    def of(x: np.ndarray, _: np.ndarray) -> np.ndarray:
        z = (x - m.mean) / m.scale
        log = m._log(z)
        top = log.max(1, keepdims=True)
        p = np.exp(log - top)
        whole = p.sum(1, keepdims=True)
        like = float((top + np.log(whole)).sum())
        p /= whole
        return np.concatenate([p.sum(0), (p.T @ z).ravel(), (p.T @ z**2).ravel(), [like]])

    return of


def _votes(m: Mixture) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    """The responsibilities of each component for the segments of each label."""

    def of(x: np.ndarray, labels: np.ndarray) -> np.ndarray:
        return (m.responsibilities(x).T @ np.eye(len(KINDS) + 1)[labels][:, :-1]).ravel()

    return of


def fit_mixture(every: Totals, labelled: Totals, x: np.ndarray, labels: np.ndarray, components: int = COMPONENTS, rounds: int = 60, seed: int = SEED) -> Mixture:
    """EM over the rows of ``every`` and the examples ``x``, from centres spread by distance among the examples; the
    ``labels`` of the examples and the rows of ``labelled`` are used for the mapping only."""
    rng = np.random.default_rng(seed)
    d = x.shape[1]
    count, first, second = np.split(every(_moments) + _moments(x, labels), [1, 1 + d])
    mean = first / count
    scale = np.sqrt(np.maximum(second / count - mean**2, 0)) + 1e-3
    z = (x - mean) / scale
    k = min(components, len(z))
    centres = [z[rng.integers(len(z))]]
    nearest = ((z - centres[0]) ** 2).sum(1)
    for _ in range(k - 1):  # k-means++
        centres.append(z[rng.choice(len(z), p=nearest / nearest.sum())] if nearest.sum() > 0 else z[0])
        nearest = np.minimum(nearest, ((z - centres[-1]) ** 2).sum(1))
    m = Mixture(mean, scale, np.full(k, 1 / k), np.array(centres), np.full((k, d), 1.0), np.zeros((k, len(KINDS))))
    last = -np.inf
    for _ in range(rounds):
        of = _expected(m)
        n, sums, squares, like = np.split(every(of) + of(x, labels), [k, k + k * d, k + 2 * k * d])
        n, sums, squares, like = n + 1e-6, sums.reshape(k, d), squares.reshape(k, d), float(like[0])
        m.weights = n / n.sum()
        m.centres = sums / n[:, None]
        m.variances = np.maximum(squares / n[:, None] - m.centres**2, 0.1)
        if abs(like - last) < 1e-4 * abs(like):
            break
        last = like
    votes = (labelled(_votes(m)) + _votes(m)(x, labels)).reshape(k, len(KINDS))
    share = (votes + 1e-3) / (votes + 1e-3).sum(1, keepdims=True)
    m.kinds = np.eye(len(KINDS))[share.argmax(1)] * 0.9 + share * 0.1
    return m


def measure(text: str | None) -> tuple[list[int], int, list[list[float]], int, bool]:
    """Of a text: characters of its segments, of its code, statistics of the segments, place of the leading one (which
    holds 0.7 of them; else -1), whether the text repeats itself."""
    parts = segments(text) if text and text.strip() else []
    plain = [lines for what, lines in parts if what != "code"]
    sizes = [sum(map(len, lines)) for lines in plain]
    code = sum(len(x) for what, lines in parts if what == "code" for x in lines)
    lead = int(np.argmax(sizes)) if sizes and max(sizes) >= 0.7 * sum(sizes) else -1
    return sizes, code, [statistics(lines) for lines in plain], lead, repeated(parts)


def measured(documents: DataFrame) -> DataFrame:
    """(doc_id, sizes, code, x, lead, again): what ``measure`` has of every document, the statistics one after the other."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes, code, x, lead, again = zip(*map(measure, b.column(1).to_pylist()), strict=True) if b.num_rows else [()] * 5
            flat = [[v for row in rows for v in row] for rows in x]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(sizes, pa.list_(pa.int32())), pa.array(code, pa.int32()), pa.array(flat, pa.list_(pa.float32())), pa.array(lead, pa.int32()), pa.array(again, pa.bool_())],
                names=["doc_id", "sizes", "code", "x", "lead", "again"],
            )

    docs = documents.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    return docs.mapInArrow(read, "doc_id bigint, sizes array<int>, code int, x array<float>, lead int, again boolean")


def totals(rows: DataFrame) -> Totals:
    """Sums over (kind, x) of what a function has of statistics and places of the labels in ``KINDS`` (-1: none); the
    driver gets one vector of the function's size from each partition."""

    def over(of: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray:
        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = None
            for b in batches:
                if b.num_rows:
                    x = b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1).astype(np.float64)
                    v = of(x, np.array([KINDS.index(k) if k else -1 for k in b.column(0).to_pylist()]))
                    total = v if total is None else total + v
            if total is not None:
                yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["v"])

        return sum((np.frombuffer(r.v) for r in rows.select("kind", "x").mapInArrow(add, "v binary").collect()), 0.0)

    return over


def model_of(rows: DataFrame, labels: DataFrame) -> Mixture:
    """The mixture of the leading segments of all ``measured`` documents and of the inspected examples, which with all labels name its components."""
    known = labels.where(F.col("doc_id").isNotNull() & F.lower(F.trim("label")).isin(*KINDS)).select(F.col("doc_id").cast("bigint").alias("doc_id"), F.lower(F.trim("label")).alias("kind")).distinct()
    lead = cut(rows.where("lead >= 0").select("doc_id", F.slice("x", F.col("lead") * len(FEATURES) + 1, len(FEATURES)).alias("x")))
    examples = [(KINDS.index(k), x[i]) for k, t in inspected_examples() for _, _, x, i, _ in [measure(t)] if i >= 0]
    every = totals(lead.select(F.lit(None).cast("string").alias("kind"), "x"))
    return fit_mixture(every, totals(lead.join(known, "doc_id")), np.array([x for _, x in examples]), np.array([k for k, _ in examples]))


def train(documents: DataFrame, labels: DataFrame) -> Mixture:
    """The mixture of all documents."""
    return model_of(cut(measured(documents)), labels)


def repeated(parts: list[tuple[str, list[str]]]) -> bool:
    """Whether more than half of a text's words stand in runs of ``SHINGLE`` words that came before in it, however far apart; code is no repetition."""
    words = [w for what, lines in parts if what != "code" for x in lines for w in x.lower().split()]
    total = len(words) + sum(len(x.split()) for what, lines in parts if what == "code" for x in lines)
    if 2 * (len(words) - len(set(words))) <= total or len(words) < 2 * SHINGLE:  # no text with fewer repeated words has so many repeated runs
        return False
    runs = len(words) - SHINGLE + 1
    return 2 * (runs - len(set(zip(*(words[i:] for i in range(SHINGLE)), strict=False)))) > total


def decided(sizes: list[int], code: int, again: bool, found: list[int]) -> str:
    """The form of more than half of the characters of segments of the forms ``found``, else prose."""
    by: Counter = Counter({"prose": code} if code else {})
    for n, k in zip(sizes, found, strict=True):
        by[KINDS[k]] += n
    kind, most = by.most_common(1)[0] if by else ("junk", 1)
    kind = kind if most * 2 > sum(by.values()) else "prose"
    return "junk" if kind == "prose" and again else kind


def kind_of(text: str | None, model: Mixture) -> str:
    sizes, code, x, _, again = measure(text)
    return decided(sizes, code, again, model.predict(np.array(x, np.float32).astype(np.float64)).tolist() if x else [])


def kinds(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, kind) of every document."""
    rows = cut(measured(documents))
    model = model_of(rows, labels)

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = b.column(3).flatten().to_numpy(zero_copy_only=False).reshape(-1, len(FEATURES)).astype(np.float64)
            found, at, out = model.predict(x).tolist() if len(x) else [], 0, []
            for sizes, code, again in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(4).to_pylist(), strict=True):
                out.append(decided(sizes, code, again, found[at : at + len(sizes)]))
                at += len(sizes)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.string())], names=["doc_id", "kind"])

    return rows.select("doc_id", "sizes", "code", "x", "again").mapInArrow(decide, "doc_id bigint, kind string")


def found(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, kind) of the documents that are not prose."""
    return kinds(documents, labels).where(F.col("kind") != "prose").distinct()


def document_statistics(documents: DataFrame) -> DataFrame:
    """The plain statistics of whole texts, by built-in functions only.

    doc_id, n_words, mean_word_length, symbol_ratio, punctuated_line_share,
    common_word_share; null and empty texts have 0 words and null shares.
    """
    text = F.coalesce("text", F.lit(""))
    tokens = F.filter(F.split(F.regexp_replace(text, r"[ \t\r\n]+", " "), " "), lambda w: w != "")
    lines = F.filter(F.split(F.regexp_replace(text, r"\r\n|\r", "\n"), "\n"), lambda x: F.regexp_replace(x, r"[ \t]+", "") != "")
    n, m = F.size(tokens), F.size(lines)

    def share(hits: Column, of: Column) -> Column:
        return F.when(of > 0, hits / of)

    words = F.filter(F.split(F.regexp_replace(F.lower(text), "[^a-z]+", " "), " "), lambda w: w != "")
    common = F.array(*[F.lit(w) for w in sorted(w for w in COMMON if w.isascii())])
    length = F.aggregate(tokens, F.lit(0), lambda a, w: a + F.length(w))
    return documents.select(
        "doc_id",
        n.cast("bigint").alias("n_words"),
        share(length, n).alias("mean_word_length"),
        share(F.length(F.regexp_replace(text, r"[A-Za-z0-9 \t\r\n]+", "")), F.length(text)).alias("symbol_ratio"),
        share(F.size(F.filter(lines, lambda x: x.rlike(r"[.!?:;][ \t]*$"))), m).alias("punctuated_line_share"),
        share(F.size(F.filter(words, lambda w: F.array_contains(common, w))), F.size(words)).alias("common_word_share"),
    )
