"""Credentials in tool inputs, observations and diffs (problem 3).

1. Every value is read once and its literals in the places of credentials are
   indexed: (literal, kind, owner, value).
2. The index is summed up per literal over the whole corpus.  Literals of a known
   token format, keys in PEM blocks and passwords in URLs or commands confirm
   themselves; a literal that is only assigned to a name is confirmed unless it is
   weak and at least ``SHARED_OWNERS`` owners (repositories) hold it, as placeholders do.
3. Every value is read again with an automaton of the confirmed literals, so a
   secret is also found where nothing around it gives it away.

The texts are read once however many secrets there are: a filter of a fixed size
says where one may end, and only these places meet the secrets (``rescan``).
Counting is pre-aggregated per literal, so a placeholder that a third of all
values hold is one row per task.

Redaction replaces the secret itself: JSON keeps its escapes and stays valid,
code keeps its quotes, a PEM block keeps its lines and their diff marks.

Defined results
    * null, empty and blank values hold nothing; whole texts are read, however long;
    * a value of ``input`` that is no valid JSON is read as plain text;
    * a record delivered twice is reported under both row_ids, a row_id once;
    * records without a repository are as many owners as they have sessions or
      different contents, whichever is less: what is delivered again is one owner;
    * of confirmed literals of more than ``LONG`` characters the end is searched for;
    * confirmed literals of fewer than ``MIN_LITERAL`` characters are searched for
      between characters that are no part of a word, and only if they are mixed.
"""

from __future__ import annotations

import base64
import binascii
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanforge.session import cut

SHARED_OWNERS = 8
MIN_LITERAL = 10  # shorter ones are searched for as whole tokens only
SHORTEST = 4
MARK = "REDACTED"

# Public token formats.
FORMATS = re.compile(
    r"(?<![A-Za-z0-9_])(?:"
    r"sk-ant-[A-Za-z0-9_-]{20,}|sk-proj-[A-Za-z0-9_-]{20,}|sk-(?!test)[A-Za-z0-9]{24,}|[rs]k_live_[A-Za-z0-9]{16,}"
    r"|gh[pousr]_[A-Za-z0-9]{26,}|github_pat_[A-Za-z0-9_]{30,}|glpat-[A-Za-z0-9_-]{18,}|hf_[A-Za-z0-9]{24,}|npm_[A-Za-z0-9]{26,}|pypi-[A-Za-z0-9_-]{30,}"
    r"|xox[abeoprs]-[A-Za-z0-9-]{20,}|(?:AKIA|ASIA)[A-Z0-9]{16}(?![A-Za-z0-9])|AIza[A-Za-z0-9_-]{30,}|SG\.[A-Za-z0-9_-]{16,}\.[A-Za-z0-9_-]{24,}"
    r"|eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}"
    r"|https://discord(?:app)?\.com/api/webhooks/\d+/[A-Za-z0-9_-]{20,}|https://hooks\.slack\.com/services/T\w+/B\w+/\w{16,}"
    r")"
)
_PEM = re.compile(r"-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----(.*?)(?:-----END (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----|\Z)", re.S)
_PEM_LINE = re.compile(r"[A-Za-z0-9+/]{24,}={0,2}")
_URL = re.compile(r"[A-Za-z][A-Za-z0-9+.-]{1,20}://([^\s:/@\"'<>]*):([^\s/\"'<>]+)@(?=[A-Za-z0-9\[])")
_BEARER = re.compile(r"\b[Bb]earer\s+([A-Za-z0-9._~+/=-]{16,})")
_BASIC = re.compile(r"\b[Bb]asic\s+([A-Za-z0-9+/_-]{10,}={0,2})")
_WORD = r"(?:pass(?:word|wd|phrase|code)?|pwd|secret|token|credentials?|(?:api|access|secret|private|signing|encryption|master|account|client|auth)[_.-]?key)"
_ASSIGN = re.compile(
    rf"([?&]?)(?<![A-Za-z])([A-Za-z0-9_.$-]{{0,40}}?{_WORD})"
    r"(?:[\"'`]?\]?[ \t]*(?::=|=>|=(?!=)|:(?!:))[ \t]*|[\"'`][ \t]*,[ \t]*(?=[\"'`]))"
    r"(?:\"([^\"\n]{4,})\"|'([^'\n]{4,})'|`([^`\n]{4,})`|([^\s\"'`,;<>(){}\[\]\\=][^\s\"'`,;<>(){}\[\]\\]{3,}))(?![\w(\[])",
    re.I,
)
_XML = re.compile(rf"<([A-Za-z0-9_.-]{{0,40}}?{_WORD})>([^<>\s]{{4,}})</", re.I)
_SPACED = re.compile(rf"(?:\b(?:ENV|ARG)\s+[A-Za-z0-9_-]*?{_WORD}|\blogin\s+\S+\s+password|\s--(?:password|token|secret|api-key|access-key|passphrase))(?:\s+|=)[\"']?([^\s\"'<>(){{}};]{{5,}})", re.I)
_BLOCK = re.compile(rf"[\"'][A-Za-z0-9_.-]{{0,40}}?{_WORD}[\"']\s*\{{[^{{}}]{{0,200}}?\bdefault\s*=\s*[\"']([^\"'\n]{{5,}})[\"']", re.I)
_COMMAND = re.compile(
    r"\b(?:mysql|mysqldump|mysqladmin|mariadb)\b[^\n|;]*?\s-p['\"]?([^\s'\"|;]{5,})"
    r"|\bsshpass\s+-p\s*['\"]?([^\s'\"]{5,})"
    r"|\b(?:docker|podman|helm registry|az acr|skopeo)\s+login\b[^\n|;]*?\s-p\s+['\"]?([^\s'\"|;]{5,})"
    r"|\b(?:curl|wget|http)\b[^\n|;]*?\s(?:-u|--user)\s+['\"]?[^\s:'\"]+:([^\s'\"|;]{5,})"
    r"|\bredis-cli\b[^\n|;]*?\s-a\s+['\"]?([^\s'\"|;]{5,})"
)
_JOINED = re.compile(r"([\"'])\s*(?:\+|\.\.|\.|&)?\s*(?:\\?\n)?\s*(?:\+|\.\.)\s*\1")
# What stands where a credential would be.
_PLACEHOLDER = re.compile(
    r"^(?:<.*>|\[.*\]|\{.*|\$.*|%[A-Za-z_]+%?|@.*|[*•.xX_#-]{3,}|x{3,}.*|change[-_ ]?(?:me|it).*|(?:your|my|insert|enter|put|the|some|any|fake|dummy|sample|example|redacted|masked|hidden|replace)[-_ ].*|"
    r"redacted|masked|hidden|secret|password|passwd|token|none|null|nil|true|false|undefined|todo|tbd|n/?a|test|dummy|placeholder|env|string|str|bytes|optional|required|admin|root|guest)$",
    re.I,
)
_STARS = re.compile(r"\*{3,}|•{3,}|x{6,}|\.{3,}|…|EXAMPLE|<[A-Za-z_ -]+>|\$\{|\{\{|\$\(")
_UUID = re.compile(r"^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$", re.I)
_NAME = re.compile(r"^[A-Za-z_][A-Za-z_]*(?:[_.][A-Za-z0-9_]+)*$|^(?:[a-z]+_)+[a-z0-9]+$|^(?:/|\./|~/|[A-Za-z]:\\)")
_CALL = re.compile(r"^(?:os\.|process\.|env\.|self\.|this\.|config\.|settings\.|secrets?\.|vault|getpass|System\.|ENV\[)")
_TRIGGERS = ("pass", "pwd", "secret", "token", "key", "earer", "asic ", "://", "sk-", "sk_live", "gh", "hf_", "npm_", "pypi-", "xox", "glpat-", "akia", "asia", "aiza", "sg.", "eyj", "credential", " -p", " -u", "--user", " -a ")
_SAFE_LOWER = re.compile(r"^[a-z]+(?:[-_. ][a-z]+)*$")


def strong(v: str) -> bool:
    """Whether a literal is random or mixed enough to be a usable secret."""
    if len(v) < 6 or _PLACEHOLDER.match(v) or _STARS.search(v) or _UUID.match(v) or _SAFE_LOWER.match(v):
        return False
    digit, lower, upper = any(c.isdigit() for c in v), any(c.islower() for c in v), any(c.isupper() for c in v)
    odd = any(not c.isalnum() and c not in "-_. /:" for c in v)
    if v.replace(".", "").replace("-", "").replace(",", "").isdigit():
        return False
    return (digit and (lower or upper)) or (lower and upper and not v.istitle() and len(set(v)) >= 6) or (odd and (lower or upper) and len(v) >= 8)


def weak(v: str) -> bool:
    """Whether an assigned literal may be a placeholder: words, a sequence or few different characters."""
    words = sum(len(w) for w in re.findall(r"[A-Z]?[a-z]{3,}|[A-Z]{4,}", v) if 0.2 <= sum(c in "aeiouyAEIOUY" for c in w) / len(w) <= 0.75)
    low = v.lower()
    return len(v) < 8 or words >= len(v) / 2 or len(set(v)) < 6 or "1234" in low or "abcd" in low


def _findable(v: str) -> bool:
    """Whether a confirmed literal can be searched for where nothing around it gives it away."""
    if len(v) >= MIN_LITERAL:
        return True
    mixed = sum((any(c.isdigit() for c in v), any(c.islower() for c in v), any(c.isupper() for c in v), any(not c.isalnum() for c in v)))
    return len(v) >= SHORTEST and mixed >= 2 and not v.istitle() and not _PLACEHOLDER.match(v) and not _SAFE_LOWER.match(v) and not v.replace(".", "").replace("-", "").isdigit()


def _whole(text: str, start: int, end: int) -> bool:
    """Whether text[start:end] is a token of its own (an escape such as \\n before it is no letter)."""
    before = text[start - 1 : start]
    if before.isalnum() and text[max(0, start - 2) : start] in ("\\n", "\\t", "\\r"):
        before = ""
    after = text[end : end + 1]
    return not (before.isalnum() or before == "_" or after.isalnum() or after == "_")


def _bare(v: str) -> bool:
    """Whether an unquoted value is a literal and not a name or a path."""
    return strong(v) and not _CALL.match(v) and not (_NAME.match(v) and not (any(c.isdigit() for c in v) and any(c.isupper() for c in v) and "_" not in v and "." not in v))


def literals(text: str) -> list[tuple[str, str]]:
    """(literal, kind) of the credentials in a text: kind ``f`` (confirms itself) or ``a`` (assigned to a name)."""
    low = text.lower()
    if not any(t in low for t in _TRIGGERS):
        return []
    out: list[tuple[str, str]] = []
    texts = [text]
    if '" + "' in text or "' + '" in text or _JOINED.search(text):
        texts.append(_JOINED.sub("", text))
    for n, t in enumerate(texts):
        hits: list[tuple[str, str]] = [(m[0], "f") for m in FORMATS.finditer(t) if not _STARS.search(m[0])]
        if "://" in t and "@" in t:
            hits += [(m[2], "f") for m in _URL.finditer(t) if not _PLACEHOLDER.match(m[2]) and not _STARS.search(m[2]) and len(m[2]) >= 4]
        if "earer" in t:
            hits += [(m[1], "f") for m in _BEARER.finditer(t) if strong(m[1]) and any(c.isdigit() for c in m[1])]
        if "asic" in t:
            for m in _BASIC.finditer(t):
                try:
                    plain = base64.b64decode(m[1] + "=" * (-len(m[1]) % 4), validate=True)
                except (binascii.Error, ValueError):
                    continue
                user, colon, password = plain.partition(b":")
                if colon and password and plain.isascii() and not _PLACEHOLDER.match(password.decode()):
                    hits.append((m[1], "f"))
        for m in _ASSIGN.finditer(t):
            quoted = m[3] or m[4] or m[5]
            v = quoted or m[6]
            if not quoted:
                if m[1]:
                    v = v.split("&", 1)[0]
                v = v.rstrip(".:!?") if not v.endswith("=") else v
            if (strong(v) and " " not in v.strip() and not _CALL.match(v)) if quoted else _bare(v):
                hits.append((v, "a"))
        if "</" in t:
            hits += [(m[2], "a") for m in _XML.finditer(t) if strong(m[2])]
        if "ENV " in t or "ARG " in t or "login " in t or "--" in t:
            hits += [(m[1], "a") for m in _SPACED.finditer(t) if _bare(m[1])]
        if "default" in t:
            hits += [(m[1], "a") for m in _BLOCK.finditer(t) if strong(m[1])]
        if " -" in t:
            for m in _COMMAND.finditer(t):
                v = next(g for g in m.groups() if g)
                if not _PLACEHOLDER.match(v) and not _STARS.search(v) and not _SAFE_LOWER.match(v):
                    hits.append((v, "f"))
        if n:  # a literal in pieces: its pieces are what the text holds
            seen = {v for v, _ in out}
            for v, kind in hits:
                if v not in seen:
                    at = 0
                    for piece in re.findall(r"[\"']([^\"'\n]{4,})[\"']", text):
                        if len(piece) >= MIN_LITERAL and piece in v and (at or v.startswith(piece) or v.endswith(piece)):
                            out.append((piece, kind))
                    out.append((v, kind))
        else:
            out += hits
    for m in _PEM.finditer(text):
        body = m[1].split("\n")
        mark = body[-1] if body[-1] in ("+", "-", " ") else ""  # of a diff, before the last line
        lines = [x for row in body for x in _PEM_LINE.findall(row[len(mark) :] if mark and row.startswith(mark) else row)]
        out += [(x, "f") for x in lines]
    return list(dict.fromkeys(out))


def _leaves(o: object, key: str = "") -> Iterator[tuple[str, str]]:
    if isinstance(o, str):
        yield key, o
    elif isinstance(o, dict):
        named = o.get("name") if isinstance(o.get("name"), str) else o.get("key") if isinstance(o.get("key"), str) else None
        for k, v in o.items():
            yield from _leaves(v, named if named and k == "value" else k)
    elif isinstance(o, list):
        last = ""
        for v in o:
            yield from _leaves(v, last.lstrip("-") if isinstance(last, str) and last.startswith("--") else key)
            last = v if isinstance(v, str) else ""


def readable(field: str, text: str) -> str:
    """The text as its reader sees it: JSON inputs as ``key: "value"`` lines."""
    if field != "input":
        return text
    try:
        o = json.loads(text)
    except (ValueError, RecursionError):
        return text.replace('\\"', '"').replace("\\n", "\n")
    if not isinstance(o, (dict, list, str)):
        return text
    return "\n".join(f'{k} = "{v}"' if v and "\n" not in v and '"' not in v else f"{k}\n{v}" for k, v in _leaves(o))


def text_values(traces: DataFrame) -> DataFrame:
    """(row_id, owner, session, digest, field, path, text) of every input, observation and diff; one projection, no shuffle."""
    kind = "struct<field:string,path:string,text:string>"
    empty = F.expr(f"CAST(array() AS array<{kind}>)")

    def value(field: str, path: Column, text: Column) -> Column:
        return F.when(text.isNotNull() & (text != ""), F.struct(F.lit(field).alias("field"), path.alias("path"), text.alias("text")))

    def of_step(s: Column, i: Column) -> Column:
        path = lambda j: F.concat_ws(".", i.cast("string"), j.cast("string"))
        return F.concat(
            F.coalesce(F.transform(s["tool_calls"], lambda c, j: value("input", path(j), c["input"])), empty),
            F.coalesce(F.transform(s["observations"], lambda o, j: value("observation", path(j), o["content"])), empty),
        )

    rows = F.concat(F.coalesce(F.flatten(F.transform("steps", lambda s, i: F.coalesce(of_step(s, i), empty))), empty), F.array(value("diff", F.lit(""), F.col("environment.vcs.diff"))))
    known = F.trim("task.repository") != ""
    one = traces.where(F.col("row_id").isNotNull()).select("row_id", F.when(known, F.col("task.repository")).alias("owner"), F.nullif(F.trim("session_id"), F.lit("")).alias("session"), F.array_compact(rows).alias("values"))
    digest = F.when(F.col("owner").isNull(), F.md5(F.concat_ws("\n", F.col("values.text"))))
    return one.withColumns({"digest": digest, "session": F.when(F.col("owner").isNull(), F.coalesce("session", digest))}).select("row_id", "owner", "session", "digest", F.inline("values"))


_INDEX = "row_id bigint, field string, path string, owner string, session string, digest string, literal string, kind string"


def literal_index(values: DataFrame) -> DataFrame:
    """The index: one row per literal of a value."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["row_id", "field", "path", "owner", "session", "digest", "literal", "kind"]
        types = [pa.int64()] + [pa.string()] * 7
        for b in batches:
            rows = []
            for row_id, owner, session, digest, field, path, text in zip(*(b.column(i).to_pylist() for i in range(7)), strict=True):
                rows += [(row_id, field, path, owner, session, digest, v, "w" if k == "a" and weak(v) else k) for v, k in literals(readable(field, text))]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=names)

    return values.select("row_id", "owner", "session", "digest", "field", "path", "text").mapInArrow(read, _INDEX)


def confirmed(index: DataFrame) -> DataFrame:
    """(literal, n_owners): the literals that are secrets."""
    n_owners = F.countDistinct("owner") + F.least(F.countDistinct("session"), F.countDistinct("digest"))
    per = index.groupBy("literal").agg(n_owners.alias("n_owners"), F.max(F.col("kind") != "w").alias("own_proof"))
    return per.where(F.col("own_proof") | (F.col("n_owners") < SHARED_OWNERS)).select("literal", "n_owners")


def automaton(words: list[tuple[str, str]]):
    """Of (form, literal) pairs: each form leads to itself and its literal."""
    import ahocorasick

    a = ahocorasick.Automaton()
    for form, w in words:
        a.add_word(form, (form, w))
    if len(a):
        a.make_automaton()
    return a


def forms(w: str) -> list[str]:
    """How a confirmed literal is written in texts: as it is, and with the escapes of JSON."""
    return list(dict.fromkeys((w, json.dumps(w, ensure_ascii=False)[1:-1], json.dumps(w)[1:-1])))


#: bytes at the end of a form by which places are looked up; shorter forms are looked up as a whole
ANCHOR = 8
#: of longer literals the last so many characters are searched for
LONG = 256
#: bytes of texts that are searched at once
TOGETHER = 1 << 18
#: bits of the filter of anchors that is broadcast, whatever the number of secrets
FILTER_BITS = 1 << 24


def _windows(data: np.ndarray, lengths: list[int]) -> Iterator[tuple[int, np.ndarray]]:
    """For each length n the n bytes from each place of a text on as one number."""
    out = data.astype(np.uint64)
    for n in range(1, max(lengths) + 1):
        if n > 1:
            out = (out[: max(0, len(data) - n + 1)] << np.uint64(8)) | data[n - 1 :]
        if n in lengths:
            yield n, out


def _slots(windows: np.ndarray, n: int, which: int) -> np.ndarray:
    """The places of windows in the filter; there are two for each."""
    with np.errstate(over="ignore"):
        h = (windows + np.uint64(n)) * np.uint64(0x9E3779B97F4A7C15)
        h = (h ^ (h >> np.uint64(32))) * np.uint64(0xC2B2AE3D27D4EB4F)
    return ((h >> np.uint64(40 if which else 16)) & np.uint64(FILTER_BITS - 1)).astype(np.int64)


def anchored(secrets: DataFrame) -> DataFrame:
    """(anchor, n, form, literal, slots): the findable forms of the confirmed literals with the bytes that they end with."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for w in filter(_findable, b.column(0).to_pylist()):
                for form in forms(w[-LONG:]):
                    raw = form.encode("utf-8", "surrogatepass")
                    n = min(ANCHOR, len(raw))
                    v = next(_windows(np.frombuffer(raw[-n:], np.uint8), [n]))[1]
                    rows.append((int(v.view(np.int64)[0]), n, form, w, [int(_slots(v, n, k)[0]) for k in (0, 1)]))
            types = [pa.int64(), pa.int32(), pa.string(), pa.string(), pa.list_(pa.int32())]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=["anchor", "n", "form", "literal", "slots"])

    return secrets.select("literal").mapInArrow(read, "anchor bigint, n int, form string, literal string, slots array<int>")


def places(values: DataFrame, filled: np.ndarray, lengths: list[int], longest: int) -> DataFrame:
    """(anchor, n, row_id, field, path, part): where a text may hold a form, with the part of the text up to there.

    A part reaches back by the longest form (and two characters for the test of whole tokens) and one character on.
    """
    sent = values.sparkSession.sparkContext.broadcast(np.packbits(filled))
    types = [pa.int64(), pa.int32(), pa.int64(), pa.string(), pa.string(), pa.string()]

    def search(keys: list[tuple], texts: list[bytes], bits: np.ndarray) -> set[tuple]:
        raw = bytes(ANCHOR).join(texts)
        starts = np.cumsum([0] + [len(t) + ANCHOR for t in texts])
        rows = set()
        for n, v in _windows(np.frombuffer(raw, np.uint8), lengths):
            at = np.flatnonzero(bits[_slots(v, n, 0)])
            at = at[bits[_slots(v[at], n, 1)]]
            of = np.searchsorted(starts, at, side="right") - 1
            for i, k, x in zip(at.tolist(), of.tolist(), v[at].view(np.int64).tolist(), strict=True):
                lo = max(int(starts[k]), i + n - longest - 2)
                rows.add((x, n, *keys[k], raw[lo : min(i + n + 4, int(starts[k]) + len(texts[k]))].decode("utf-8", "ignore")))
        return rows

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.unpackbits(sent.value).astype(bool)
        for b in batches:
            keys, texts, size, rows = [], [], 0, set()
            for *key, text in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                keys.append(tuple(key))
                texts.append(text.encode("utf-8", "surrogatepass"))
                size += len(texts[-1])
                if size >= TOGETHER:
                    rows |= search(keys, texts, bits)
                    keys, texts, size = [], [], 0
            rows |= search(keys, texts, bits) if keys else set()
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=["anchor", "n", "row_id", "field", "path", "part"])

    return values.select("row_id", "field", "path", "text").mapInArrow(read, "anchor bigint, n int, row_id bigint, field string, path string, part string")


def rescan(values: DataFrame, secrets: DataFrame) -> DataFrame:
    """(row_id, field, path, literal) of every confirmed literal in every value, in one pass over the texts.

    The forms' last bytes fill a filter of a fixed size that is broadcast; the few places that pass it are brought
    together with the forms of the same last bytes, and an automaton of these is run over the part of the text
    there.  Neither the driver nor an executor ever holds all secrets.
    """
    known = cut(anchored(secrets))
    size = known.agg(F.max(F.octet_length("form")).alias("longest"), F.collect_set("n").alias("ns")).first()
    spark = values.sparkSession
    schema = "row_id bigint, field string, path string, literal string"
    if not size.longest:
        return spark.createDataFrame([], schema)
    filled = np.zeros(FILTER_BITS, bool)
    # at most FILTER_BITS numbers, as compact batches
    filled[known.select(F.explode("slots").alias("slot")).distinct().toArrow().column(0).to_numpy()] = True
    found = places(values, filled, sorted(size.ns), size.longest)
    # forms of one anchor (those of equal ends) are few; a place that many values share is one row for each value
    per = known.groupBy("anchor", "n").agg(F.collect_set(F.struct("form", "literal")).alias("forms"))
    both = found.join(per, ["anchor", "n"]).select("row_id", "field", "path", "part", "forms")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, made = set(), {}
            for row_id, field, path, part, words in zip(*(b.column(i).to_pylist() for i in range(5)), strict=True):
                key = tuple(sorted((w["form"], w["literal"]) for w in words))
                if key not in made:
                    made[key] = automaton(list(key))
                for e, (form, w) in made[key].iter(part):
                    if len(w) >= MIN_LITERAL or _whole(part, e + 1 - len(form), e + 1):
                        rows.add((row_id, field, path, w))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate([pa.int64()] + [pa.string()] * 3)], names=["row_id", "field", "path", "literal"])

    return both.mapInArrow(scan, schema)


def secret_hits(traces: DataFrame) -> DataFrame:
    """(row_id, field, path, literal): every confirmed secret where it stands."""
    values = text_values(traces)
    index = cut(literal_index(values))
    secrets = cut(confirmed(index))
    placed = index.join(secrets.select("literal"), "literal").select("row_id", "field", "path", "literal")
    return placed.unionByName(rescan(values, secrets)).distinct()


def found(traces: DataFrame) -> DataFrame:
    """(row_id, field, path): every value that holds a credential."""
    return secret_hits(traces).select("row_id", "field", "path").distinct()


def redact(text: str, words: list[str]) -> str:
    """``text`` with each literal, plain or JSON-escaped, replaced."""
    for w in sorted(words, key=len, reverse=True):
        held = [f for f in forms(w) if f in text] or forms(w[-LONG:])  # of a very long one perhaps only the end
        for form in held:
            if len(w) >= MIN_LITERAL:
                text = text.replace(form, MARK)
                continue
            at, parts, whole = 0, [], False
            for m in re.finditer(re.escape(form), text):
                if _whole(text, *m.span()):
                    parts += [text[at : m.start()], MARK]
                    at, whole = m.end(), True
            # where it stands in a longer token only, it was found there by its context
            text = "".join(parts) + text[at:] if whole else text.replace(form, MARK)
    return text


def redacted(traces: DataFrame) -> DataFrame:
    """(row_id, field, path, text): the values that held credentials, without them."""
    hits = secret_hits(traces).groupBy("row_id", "field", "path").agg(F.collect_set("literal").alias("words"))
    both = text_values(traces).dropDuplicates(["row_id", "field", "path"]).join(hits, ["row_id", "field", "path"]).select("row_id", "field", "path", "text", "words")

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [redact(t, w) for t, w in zip(b.column(3).to_pylist(), b.column(4).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(out, pa.string())], names=["row_id", "field", "path", "text"])

    return both.mapInArrow(clean, "row_id bigint, field string, path string, text string")
