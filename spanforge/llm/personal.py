"""Personal information in task descriptions and observations (problem 6).

Weak supervision.  Broad patterns propose spans; labelers - patterns, gazetteers
and context - vote for, against or not at all on each.  Expectation-maximisation
over the counts of vote patterns estimates each labeler's reliability and the
probability of every pattern, and a logistic span classifier, trained on these
probabilities over a bounded sample of spans (``TRAIN_SPANS`` a kind, the lowest
by hash), decides on votes and shape together.

Values are read in one pass without a shuffle; what is shuffled are counts per
vote pattern (a few hundred rows) and the sample.  The model is a fixed number
of weights.  Every span of every value is then decided by it.

Defined results
    * null, empty and blank texts hold nothing; whole texts are read;
    * a value with several spans of a kind is reported once for the kind;
    * overlapping spans of different kinds: the longest is replaced;
    * a record delivered twice is reported under both row_ids.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanforge.session import cut

KINDS = ("email", "phone", "idnum", "address", "name")
MARKS = {"email": "[EMAIL]", "phone": "[PHONE]", "idnum": "[ID]", "address": "[ADDRESS]", "name": "[NAME]"}
TRAIN_SPANS = 4000
BEFORE, AFTER = 48, 32

# The most frequent given names of the public US census of 1990, men's and women's, in its order.
GIVEN = set(
    """james john robert michael william david richard charles joseph thomas christopher daniel paul mark donald george kenneth steven edward brian ronald anthony kevin jason matthew
    gary timothy jose larry jeffrey frank scott eric stephen andrew raymond gregory joshua jerry dennis walter patrick peter harold douglas henry carl arthur ryan roger joe juan jack
    albert jonathan justin terry gerald keith samuel willie ralph lawrence nicholas roy benjamin bruce brandon adam harry fred wayne billy steve louis jeremy aaron randy howard eugene
    carlos russell bobby victor martin ernest phillip todd jesse
    mary patricia linda barbara elizabeth jennifer maria susan margaret dorothy lisa nancy karen betty helen sandra donna carol ruth sharon michelle laura sarah kimberly deborah
    jessica shirley cynthia angela melissa brenda amy anna rebecca virginia kathleen pamela martha debra amanda stephanie carolyn christine marie janet catherine frances ann joyce
    diane alice julie heather teresa doris gloria evelyn jean cheryl mildred katherine joan ashley judith rose janice kelly nicole judy christina kathy theresa beverly denise tammy
    irene jane lori rachel marilyn andrea kathryn louise sara anne""".split()
)
# Accounts that belong to no person.
ROLES = set(
    """git deploy noreply no-reply donotreply do-not-reply root admin administrator build ci cd svc service app bot runner ops devops support help helpdesk info contact hello team sales
    security abuse postmaster webmaster hostmaster mailer-daemon daemon nobody www www-data user users ubuntu ec2-user jenkins github gitlab notifications notification alerts alert
    billing careers jobs press office system test tests example someone somebody anyone you your me name email mail writer loader reader backup monitor cron api docker registry
    postgres mysql redis dev staging prod release releases dependabot renovate hg svn ssh""".split()
)
# Ordinary words that begin or end capitalised phrases which name no person.
NOT_NAMES = set(
    """pull request bot studio visual service server code github google microsoft amazon apple android windows linux mac open source unit test tests user guide read me merge commit branch
    issue new old big data machine learning monday tuesday wednesday thursday friday saturday sunday january february march april may june july august september october november december
    content type accept cookies sign menu home docs share pricing search back next access control allow origin build failed error warning info debug the this that there these those when
    what while where after before if its it my we you our for both by to please nobody most and or not session key value table file public private certificate begin end id
    street avenue road lane drive court way place square""".split()
)
_STREET = r"(?:Street|St|Avenue|Ave|Road|Rd|Lane|Ln|Drive|Dr|Court|Ct|Way|Boulevard|Blvd|Place|Pl|Square|Sq|Terrace|Close|Crescent|Highway|Hwy|Parkway|Row|Walk)"
_TOWN = r"[A-Z][a-z]+(?:\s[A-Z][a-z]+)?(?:,?\s[A-Z]{2}\b)?"
#: a town behind a comma, or on the next line (also a written \n) if a postal code follows it
_CITY = rf"(?:,\s+(?:\d{{4,6}}\s*)?{_TOWN}(?:\s+\d{{5}})?|\s*(?:\r?\n|\\n)\s*{_TOWN}\s+\d{{5}})?"

CANDIDATES = {
    "email": re.compile(
        r"(?<![\w.+-])[A-Za-z0-9][A-Za-z0-9._%+'-]*(?:@| @ |\s*[\[({<]\s*at\s*[\])}>]\s*|\s+at\s+(?=[a-z0-9-]+\s+dot\s)|&#64;|%40|＠)[A-Za-z0-9-]+(?:(?:\.|\s*[\[({<]\s*dot\s*[\])}>]\s*|\s+dot\s+)[A-Za-z0-9-]+)*"
        r"(?:\.|\s*[\[({<]\s*dot\s*[\])}>]\s*|\s+dot\s+)[A-Za-z]{2,}(?![\w-])",
        re.I,
    ),
    "phone": re.compile(
        r"(?<![\w.+/@-])(?:\+\s?\d{1,3}[\s. -]?(?:\(0?\d{1,4}\)|\d{1,4})(?:[\s. /-]?\d{2,4}){2,5}|00\d{1,3}[\s.-]\d{1,4}(?:[\s.-]?\d{2,4}){2,4}|\(\d{3}\)\s?\d{3}[\s.-]?\d{4}|\d{3}([\s. -])\d{3}\1\d{4}"
        r"|1[\s.-]\d{3}[\s.-]\d{3}[\s.-]\d{4}|0\d{3,4}[\s-]?\d{6}|0\d{2,4}[\s-]\d{3,4}[\s-]\d{3,4}|\d{10,11})(?:[\s,]*(?:ext|x|extension)\.?\s*\d{1,6})?(?![\w-]|\.\d)",
        re.I,
    ),
    "idnum": re.compile(
        r"(?<![\w.+/-])(?:(?:SSN|social security(?: number| no\.?)?|tax id|tin)[:#\s]*\d{3}[\s.-]?\d{2}[\s.-]?\d{4}|\d{3}-\d{2}-\d{4}|\d{3}\s\d{2}\s\d{4}"
        r"|[A-Z]{2}\s?\d{2}\s?\d{2}\s?\d{2}\s?[A-D]|passport(?: no\.?| number| nr\.?| #)?[:#\s]*[A-Z]{1,2}\d{6,9}"
        r"|(?:national(?: id| insurance)?|identity|id card|personal)(?: id| no\.?| number| nr\.?)*[:#\s]*[A-Z0-9]{2,}[\s-]?\d{3,}[A-Z0-9-]*|\d{6}-\d{4}|\d{5}-\d{2}-\d{6})(?![\w-])",
        re.I,
    ),
    "address": re.compile(
        rf"(?:(?:Flat|Apt|Apartment|Unit|Suite)\.?\s\d+[A-Za-z]?,\s)?(?<![\w.:/-])\d{{1,5}}[A-Za-z]?\s(?:[A-Z][a-z]+\s){{1,3}}{_STREET}\b\.?(?:,\s(?:Flat|Apt|Apartment|Unit|Suite|#)\.?\s?\d+[A-Za-z]?)?{_CITY}"
        rf"|\b[A-Z][a-z]+(?:weg|straße|strasse|gasse|allee|platz|laan|straat|gata|vej)\s\d{{1,4}}[a-z]?(?:,\s\d{{4,5}}\s?[A-Za-z][a-z]+(?:\s[A-Z][a-z]+)?)?"
        rf"|\b(?:rue|avenue|boulevard|via|calle|plaza)\s(?:de\s|la\s|du\s)*[A-Z][a-z]+,?\s\d{{1,4}}\b"
        rf"|\bP\.?\s?O\.?\sBox\s\d+"
    ),
}
CANDIDATES["address_caseless"] = re.compile(CANDIDATES["address"].pattern.replace("[A-Z][a-z]+", "[A-Za-z]+"), re.I)
_TITLE = r"(?:Mr|Mrs|Ms|Mx|Miss|Dr|Prof|Professor|Sir|Herr|Frau|Mme|Mlle)\.?"
_CAP = r"(?:Mac|Mc|Fitz|[OD]['’])?[A-ZÀ-Ý][a-zß-ÿ]+(?:[-'’][A-Z][a-z]+)?"
# Words that begin a sentence or a heading before a name.
_FIRST = r"(?!(?:Ask|My|The|A|An|Tell|Call|Email|Mail|Contact|Dear|Hi|Hello|Thanks|From|To|By|For|With|Reported|Author|Reviewed|Signed|Tested|Acked|Use|Send|Ticket|Row|See|And|Or|But|If|When|What|Please|Both|Most|Nobody|Its|It|We|This|There|After|Before|In|On|At|Is|Was|Has|Opened)\b)"
NAME = re.compile(
    rf"\b{_TITLE}\s+(?:{_CAP}\s)?(?:[A-Z]\.\s)?{_CAP}\b|\b{_FIRST}{_CAP}\s(?:[A-Z]\.\s?)?{_CAP}\b|\b{_FIRST}{_CAP},\s{_CAP}(?:\s[A-Z]\.)?(?!\w)"
)
_CUE = (
    r"(?:\bAuthor:|\bCommitter:|[A-Z][a-z]+(?:-[a-z]+)*-by:|\bFN:|\bassignee\b\W{1,6}|\bfull_?name\b\W{1,6}|\bReported by|\b(?:ask|tell|call|contact|colleague|manager|reviewer)|\b(?:form|request|account|application) (?:for|of)|\bVALUES\s*\(\s*\d+,\s*['\"]|\n-- ?\r?\n|\^[0-9a-f]{6,}\s\("
    r"|^\d+,|\n\d+,|\bContact:?|\bcontact person:?|\bRegards,?|\bThanks,|\bdear|\bowner\b\W{1,6}|\bname\b['\"]?\s*[:=]\s*['\"]?|\bcustomer|\bpatient|\bemployee|\bapplicant)\s*['\"]?$"
)
CUE = re.compile(_CUE, re.I)
#: after a cue also names in capitals and in lower case
CUED_NAME = re.compile(
    r"(?:\b(?:Author:|Committer:|[A-Z][a-z]+(?:-[a-z]+)*-by:|FN:|Reported by|[Aa]sk|[Tt]ell|[Cc]olleague|[Ff]orm for)\s+|\n-- ?\r?\n|^\d+,|(?<=\n)\d+,|\bassignee\s*=\s*[\"']|\bVALUES\s*\(\d+,\s*['\"])((?:[A-Z][A-Z'-]+(?:,)?\s(?:[A-Z]\.\s)?[A-Z][A-Z'-]+))(?![A-Z])"
    r"|[\"'](?:full_?name|name|first_name|last_name|customer|contact|owner|assignee|author)[\"']\s*:\s*[\"']([A-Za-zÀ-ÿ'-]{2,}(?:,)?\s(?:[A-Za-z]\.?\s)?[A-Za-zÀ-ÿ'-]{2,})[\"']"
)
#: a word of a street address before, in or behind a span
_PLACE = re.compile(rf"(?:\b\d{{1,5}}[A-Za-z]?\s(?:[A-Za-z]+\s){{0,2}}|\b{_STREET}\.?,?\s(?:[A-Za-z]+\s)?)$", re.I)
_PLACED = re.compile(rf"\b{_STREET}\b|^(?:Apt|Flat|Unit|Suite)\b", re.I)

_MAIL_CUE = re.compile(r"(?:mail|cc|to|from|with|by|author|contact|report|ticket|reach|write|<|,|;|:|\"|=|\))\W*$", re.I)
_SSH = re.compile(r"(?:\b(?:ssh|scp|rsync|sftp|mosh|clone|remote add \S+|set-url \S+|origin)\s+(?:-\S+\s+)*$|://\S*$|ssh-\S+\s+\S+\s+$)")
_MACHINE = re.compile(r"^(?:db|pg|api|hub|queue|cache|build|git|registry|mx|smtp|ns\d*|www|host|node|srv|vm|prod|staging|dev|ci|runner|localhost|internal|mail-relay)\d*$", re.I)
_PHONE_CUE = re.compile(r"(?:\btel|phone|call|cell|mobile|fax|reach|dial|ring|\+?number|whatsapp|sms|\bTEL;|contact|,|\n)[^\n]{0,22}$|^$", re.I)
_NUMBER_CUE = re.compile(r"(?:order|bytes|epoch|build|host|port|version|commit|sha|size|offset|pid|uid|count|total|line|took|of|index|issue|ticket #|sku|isbn|invoice)\W{0,3}$", re.I)
_ID_CUE = re.compile(r"(?:ssn|social|passport|national|applicant|identity|insurance|tax|citizen|person|form for|row with|licen[cs]e|values|card)[^\n]{0,40}$", re.I)
_ADDRESS_CUE = re.compile(r"(?:lives? at|ship|deliver|address|home|located|street|moved to|resid|send (?:it )?to|bill(?:ing|ed)?\b|office at)[^\n]{0,24}$", re.I)
#: every way of writing the @ that the pattern of mails takes
_MAIL_AT = re.compile(r"[@＠]|%40|&#64;|[\[({<]\s*at\s*[\])}>]|\sat\s+[a-z0-9-]+\s+dot\s", re.I)
#: without capitals and without a cue only words that mean nothing but a street propose an address, and no phrase such as "2 cars in the road"
_PLAIN_STREET = re.compile(r"\b(?:street|avenue|ave|road|rd|lane|boulevard|blvd|terrace|crescent|highway|hwy|parkway)\b|p\.?\s?o\.?\sbox", re.I)
_NO_STREET = re.compile(r"\b(?:in|on|of|the|a|an|at|to|and|or|for|from|per|by|with|is|are|was)\b", re.I)

LABELERS = {
    "email": ("syntax", "personal_local", "role_account", "machine_place", "example_domain", "mail_context", "machine_host"),
    "phone": ("known_format", "phone_context", "number_context", "plausible_length", "even_separators", "own_line"),
    "idnum": ("known_format", "id_context", "number_context", "valid_ranges"),
    "address": ("street_word", "address_context", "town_or_flat", "code_context"),
    "name": ("given_name", "name_context", "title", "place", "ordinary_word", "product_context"),
}


def _vote(yes: bool, no: bool = False) -> int:
    return 1 if yes else -1 if no else 0


def votes(kind: str, s: str, before: str, after: str) -> list[int]:
    """The labelers' votes on a span: 1 for, -1 against, 0 abstains."""
    if kind == "email":
        plain = re.sub(r"\s*[\[({<]\s*at\s*[\])}>]\s*|&#64;|%40|＠|\s+at\s+", "@", s, flags=re.I)
        local, _, domain = plain.partition("@")
        local, domain = local.strip().lower(), re.sub(r"\s*[\[({<]?\s*\bdot\b\s*[\])}>]?\s*", ".", domain.strip().lower())
        parts = re.split(r"[._+-]+", local)
        labels = domain.split(".")
        personal = bool(GIVEN & set(parts)) or not any(re.sub(r"\d+$", "", p) in ROLES or _MACHINE.match(p) for p in parts)
        ssh = bool(_SSH.search(before)) or bool(re.match(r":[\w~/.-]+", after)) or ":" in local
        return [
            _vote(len(labels) >= 2 and labels[-1].isalpha() and len(labels[-1]) >= 2, True),
            _vote(personal and local not in ROLES),
            _vote(False, local in ROLES or (parts[0] in ROLES and len(parts) == 1)),
            _vote(False, ssh),
            _vote(False, ".".join(labels[-2:]) in ("example.com", "example.org", "example.net")),
            _vote(bool(_MAIL_CUE.search(before)) or after[:1] == ">"),
            _vote(False, len(labels) >= 3 and bool(_MACHINE.match(labels[0]))),
        ]
    digits = sum(c.isdigit() for c in s)
    if kind == "phone":
        bare = s.isdigit()
        return [
            _vote(not bare and bool(re.match(r"\+|\(|00|0\d|\d{3}\D|1\D", s)), bare),
            _vote(bool(_PHONE_CUE.search(before))),
            _vote(False, bool(_NUMBER_CUE.search(before))),
            _vote(9 <= digits <= 19, True),
            _vote(not bare and len(set(re.sub(r"[\d()+]|ext.*", "", s, flags=re.I))) <= 2, bare),
            _vote(bool(re.search(r"(?:^|\n)\s*$", before)) and bool(re.match(r"\s*(?:\r?\n|$|\.)", after))),
        ]
    if kind == "idnum":
        core = re.sub(r"\D", "", s)
        ssn = re.search(r"(\d{3})[\s.-]?(\d{2})[\s.-]?(\d{4})$", s)
        odd = bool(re.match(r"\d{5}-", s))
        ok = not (ssn and len(core) == 9 and (ssn[1] in ("000", "666") or ssn[1][0] == "9" or ssn[2] == "00" or ssn[3] == "0000"))
        return [_vote(not odd, odd), _vote(bool(_ID_CUE.search(before)) or s[:1].isalpha()), _vote(False, bool(_NUMBER_CUE.search(before))), _vote(ok and not odd, True)]
    if kind == "address":
        code = bool(re.search(r"[={(\[]\s*$", before)) and not _ADDRESS_CUE.search(before)
        return [
            _vote(True),
            _vote(bool(_ADDRESS_CUE.search(before))),
            _vote(bool(re.search(r"\b(?:Flat|Apt|Apartment|Unit|Suite)\b|,\s", s, re.I))),
            _vote(False, code),
        ]
    words = [w for w in re.split(r"[\s,.]+", s) if len(w) > 1]
    low = [w.lower() for w in words]
    titled = bool(re.match(rf"{_TITLE}\s", s, re.I))
    ordinary = sum(w in NOT_NAMES for w in low)
    return [
        _vote(any(w in GIVEN for w in low)),
        _vote(bool(CUE.search(before)) or bool(re.match(r"\W{0,3}<[^<>@\s]+@", after)) or bool(re.match(r"\s\d{4}-\d\d-\d\d\s", after))),
        _vote(titled),
        _vote(False, bool(_PLACED.search(s)) or bool(_PLACE.search(before))),
        _vote(False, ordinary >= 1),
        _vote(False, bool(re.search(r"\b(?:the|in|on|of|by|a|an|with|using)\s$", before)) and not CUE.search(before) and bool(re.match(r"\s(?:service|server|bot|team|api|app|project|product|studio|release|restarted|in )|$", after))),
    ]


def shape_features(kind: str, s: str, before: str, after: str) -> list[float]:
    """What the final classifier sees beside the votes."""
    n = len(s)
    return [
        min(n, 60) / 60,
        sum(c.isdigit() for c in s) / max(n, 1),
        sum(c.isupper() for c in s) / max(n, 1),
        float("\n" in s),
        float(before[-1:].isspace() or not before),
        float(before[-1:] in "\"'<(:;,="),
        float(after[:1] in ".,;:)\"'>"),
        float(after[:1].isspace() or not after),
    ]


def spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the spans that the patterns propose."""
    out: list[tuple[str, int, int]] = []
    if _MAIL_AT.search(text):
        out += [("email", m.start(), m.end()) for m in CANDIDATES["email"].finditer(text)]
    out += [("phone", m.start(), m.end()) for m in CANDIDATES["phone"].finditer(text)]
    out += [("idnum", m.start(), m.end()) for m in CANDIDATES["idnum"].finditer(text)]
    out += [("address", m.start(), m.end()) for m in CANDIDATES["address"].finditer(text)]
    known = [(a, b) for k, a, b in out if k == "address"]
    for m in CANDIDATES["address_caseless"].finditer(text):
        if not any(a < m.end() and m.start() < b for a, b in known) and (_ADDRESS_CUE.search(text[max(0, m.start() - BEFORE) : m.start()]) or (_PLAIN_STREET.search(m[0]) and not _NO_STREET.search(m[0]))):
            out.append(("address", m.start(), m.end()))
    mails = [(a, b) for k, a, b in out if k == "email"]
    taken: list[tuple[int, int]] = []
    for m in CUED_NAME.finditer(text):
        g = 1 if m[1] else 2
        taken.append(m.span(g))
        out.append(("name", *m.span(g)))
    for m in NAME.finditer(text):
        a, b = m.span()
        if not any(x < b and a < y for x, y in taken) and not any(x <= a and b <= y for x, y in mails):
            out.append(("name", a, b))
    return out


def text_values(traces: DataFrame) -> DataFrame:
    """(row_id, field, path, text) of task descriptions and observation contents; one projection, no shuffle."""
    kind = "struct<field:string,path:string,text:string>"
    empty = F.expr(f"CAST(array() AS array<{kind}>)")

    def value(field: str, path: Column, text: Column) -> Column:
        return F.when(text.isNotNull() & (text != ""), F.struct(F.lit(field).alias("field"), path.alias("path"), text.alias("text")))

    def of_step(s: Column, i: Column) -> Column:
        return F.coalesce(F.transform(s["observations"], lambda o, j: value("observation", F.concat_ws(".", i.cast("string"), j.cast("string")), o["content"])), empty)

    rows = F.concat(F.coalesce(F.flatten(F.transform("steps", of_step)), empty), F.array(value("task", F.lit(""), F.col("task.description"))))
    return traces.where(F.col("row_id").isNotNull()).select("row_id", F.inline(F.array_compact(rows)))


_CAND = "row_id bigint, field string, path string, pii_kind string, begin int, end int, votes string, shape array<float>"


def candidate_spans(values: DataFrame) -> DataFrame:
    """One row per proposed span with its votes (text of +, - and 0) and shape."""
    sign = {1: "+", 0: "0", -1: "-"}

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.string(), pa.list_(pa.float32())]
        names = ["row_id", "field", "path", "pii_kind", "begin", "end", "votes", "shape"]
        for batch in batches:
            rows = []
            for row_id, field, path, text in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                for kind, a, b in spans(text):
                    s, before, after = text[a:b], text[max(0, a - BEFORE) : a], text[b : b + AFTER]
                    rows.append((row_id, field, path, kind, a, b, "".join(sign[v] for v in votes(kind, s, before, after)), shape_features(kind, s, before, after)))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=names)

    return values.select("row_id", "field", "path", "text").mapInArrow(read, _CAND)


def estimate(patterns: dict[str, int], kind: str, rounds: int = 50) -> dict[str, float]:
    """Probability of each vote pattern by expectation-maximisation.

    Votes are independent given the truth; a labeler has a rate of +, 0 and -
    for either truth.  The start is the majority of the votes, counts are
    smoothed by a prior that labelers vote right more often than wrong.
    """
    pats = sorted(patterns)
    n = np.array([patterns[p] for p in pats], float)
    v = np.array([[{"+": 0, "0": 1, "-": 2}[c] for c in p] for p in pats])
    score = np.array([p.count("+") - 2.5 * p.count("-") for p in pats])
    q = 1 / (1 + np.exp(-2 * (score - 0.5)))
    prior = np.array([[6.0, 3.0, 0.2], [0.5, 3.0, 4.0]])  # truth x vote
    for _ in range(rounds):
        like = np.zeros((2, len(pats)))
        for truth, w in ((0, q), (1, 1 - q)):
            for j in range(v.shape[1]):
                c = np.bincount(v[:, j], weights=w * n, minlength=3)
                rate = (c + prior[truth] * max(1.0, 0.01 * n.sum())) / (c.sum() + prior[truth].sum() * max(1.0, 0.01 * n.sum()))
                like[truth] += np.log(rate[v[:, j]])
            like[truth] += np.log(((w * n).sum() + 1) / (n.sum() + 2))
        new = 1 / (1 + np.exp(np.clip(like[1] - like[0], -50, 50)))
        if np.abs(new - q).max() < 1e-6:
            break
        q = new
    return dict(zip(pats, q.tolist(), strict=True))


def _design(vote: str, shape: list[float]) -> list[float]:
    out = [1.0]
    for c in vote:
        out += [float(c == "+"), float(c == "-")]
    return out + list(shape)


def fit_logistic(x: np.ndarray, y: np.ndarray, l2: float = 0.05, rounds: int = 25) -> np.ndarray:
    """Weights of a logistic model of soft labels (Newton steps)."""
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (p - y) + l2 * w
        h = (x * (p * (1 - p))[:, None]).T @ x + np.eye(len(w)) * (l2 + 1e-6)
        step = np.linalg.solve(h, g)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w


def train(cands: DataFrame) -> dict[str, list[float]]:
    """The span classifier: weights per kind."""
    counts: dict[str, dict[str, int]] = {k: {} for k in KINDS}
    for r in cands.groupBy("pii_kind", "votes").agg(F.count(F.lit(1)).alias("n")).collect():  # at most 3^7 patterns a kind
        counts[r.pii_kind][r.votes] = r.n
    # the spans of a kind with the lowest hashes; as their number is known, hashes that cannot be among them are left out first
    draw = F.xxhash64("row_id", "field", "path", "begin")
    sample = []
    for k in KINDS:
        n = sum(counts[k].values())
        if n:
            share = min(1.0, (TRAIN_SPANS + 8 * TRAIN_SPANS**0.5) / n)
            low = cands.where((F.col("pii_kind") == k) & (draw <= F.lit(int(-(2**63) + share * (2**64 - 2**11)))))
            sample += low.orderBy(draw, "row_id", "path", "begin").limit(TRAIN_SPANS).select("pii_kind", "votes", "shape").collect()
    model = {}
    for kind in KINDS:
        if not counts[kind]:
            continue
        q = estimate(counts[kind], kind)
        rows = [(_design(r.votes, r.shape), q[r.votes]) for r in sample if r.pii_kind == kind]
        model[kind] = fit_logistic(np.array([a for a, _ in rows]), np.array([b for _, b in rows])).tolist()
    return model


def decided_spans(traces: DataFrame) -> DataFrame:
    """(row_id, field, path, pii_kind, begin, end): the spans that hold personal information."""
    cands = cut(candidate_spans(text_values(traces)))
    model = {k: np.array(w) for k, w in train(cands).items()}

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = [i for i, (k, v, s) in enumerate(zip(b.column(3).to_pylist(), b.column(6).to_pylist(), b.column(7).to_pylist(), strict=True)) if float(np.dot(_design(v, s), model[k])) > 0]
            yield b.select(["row_id", "field", "path", "pii_kind", "begin", "end"]).take(pa.array(keep, pa.int32()))

    return cands.mapInArrow(decide, "row_id bigint, field string, path string, pii_kind string, begin int, end int")


def found(traces: DataFrame) -> DataFrame:
    """(row_id, field, path, pii_kind), one row each."""
    return decided_spans(traces).select("row_id", "field", "path", "pii_kind").distinct()


def replace_spans(text: str, marks: list[tuple[int, int, str]]) -> str:
    """``text`` with typed placeholders; of overlapping spans the longest stays."""
    kept: list[tuple[int, int, str]] = []
    for a, b, k in sorted(set(marks), key=lambda m: (m[0] - m[1], m)):
        if all(b <= x or y <= a for x, y, _ in kept):
            kept.append((a, b, k))
    for a, b, k in sorted(kept, reverse=True):
        text = text[:a] + MARKS[k] + text[b:]
    return text


def redacted(traces: DataFrame) -> DataFrame:
    """(row_id, field, path, text): the values that held personal information, with placeholders."""
    marks = decided_spans(traces).groupBy("row_id", "field", "path").agg(F.collect_set(F.struct("begin", "end", "pii_kind")).alias("marks"))
    both = text_values(traces).dropDuplicates(["row_id", "field", "path"]).join(marks, ["row_id", "field", "path"]).select("row_id", "field", "path", "text", "marks")

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [replace_spans(t, [(m["begin"], m["end"], m["pii_kind"]) for m in ms]) for t, ms in zip(b.column(3).to_pylist(), b.column(4).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(out, pa.string())], names=["row_id", "field", "path", "text"])

    return both.mapInArrow(clean, "row_id bigint, field string, path string, text string")
