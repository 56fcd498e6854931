"""Template residue, filler text, error pages and script notices.

A document is cut into segments (lines and sentences).  Weak labels come from
response-status lines and phrases; a regularised logistic model of hashed
character, shape and word n-grams with length, place and title features is
fitted on a bounded sample of them and scores every segment of every document by
its best window of a few words.  The model decides which segments are taken;
those are checked exactly, so that notation and reports of errors are let go.
Sources stand for hosts: a fifth of them is held out of the fit and the model is
judged on those.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.blocks import mix, slices

BITS = 18
#: Labelled segments of each kind that the model may be fitted on.
SAMPLE = {"positive": 12_000, "near": 6_000, "plain": 18_000}
#: Documents, about, of which the labelled segments are drawn by a hash of the id.
SAMPLE_DOCUMENTS = 40_000
#: Characters of the windows that are scored, and how far they are apart.
WINDOW, STRIDE = 64, 16
#: Value of a length, title or place feature; an n-gram's is 1.
EXTRA = 0.25
#: One source in so many is held out of the fit.
HELD_OUT = 5

_CUT = re.compile(r"\n+|(?<=[.!?…])\s+|(?<=[。！？])")
_QUOTED = re.compile(r"`[^`\n]*`|\$(?!\{)[^$\n]{1,400}\$")

#: Slots where a value should stand.
SLOTS = re.compile(
    r"""
    \{\{[^{}\n]{1,60}\}\} | \{%[^{}\n]{1,60}%\} | <%[^<>\n]{1,60}%> | [$\#]\{\s*\w[\w.]*\s*\} | %\(\w+\)[sdif] | %%\w{2,}%%
    | (?<![\w\\^_$\#{%])\{\s*[^\W\d_]\w{1,40}\s*\}(?!\})
    | (?<!_)__[A-Z]\w*?__(?!_) | \[\[\s*\w[\w\ ]*\]\] | <<\s*\w[\w\ ]*>> | <[A-Z][A-Z_]{1,30}> | \[[A-Z][a-z]\w{1,30}\] | \[N[A-Z][a-z]\w*\]
    | <\s*(?:[Ii]nsert|[Aa]dd|[Ee]nter|[Yy]our)\s[^<>\n]{1,50}> | <[^<>\n]{1,30}(?:待定|待填|待补)>
    | \[\s*(?:TODO|TBD|TBA|FIXME|INSERT|PLACEHOLDER|XXX)\b[^\[\]\n]{0,60}\] | \[[^\[\]\n]{1,50}\sto\ be\ (?:added|inserted|filled\ in|supplied|provided|confirmed|determined)\]
    | [\[【(（](?:待|请|此处)(?:填写|填入|填|补充|补|定|输入)[^\]】)）\n]{0,40}[\]】)）] | @@\w[\w.\ ]{0,40}@@ | [(（\[][^()（）\[\]\n]{1,40}[:：]\s*[?？]{2,}\s*[)）\]] | (?<![\w%])%[A-Z][A-Z_]{2,}%(?![\w%])
    | \[\s*(?:Your|Insert|Enter|Add)\s[^\[\]\n]{1,40}\]
    | _{4,} | (?<![A-Za-z])X{4,}(?![A-Za-z])
    """,
    re.VERBOSE,
)

#: Filler in place of content.
FILLER = re.compile(
    r"""
    \b(?:lorem\s+ipsum|dolor\s+sit\s+amet|consectetur|adipiscing|exercitation\s+ullamco)\b | \b(?:ullamco|eiusmod|aliquip|incididunt|nostrud)\b
    | ^(?:blindtext|texto\s+de\s+relleno|sample\s+text|dummy\s+(?:text|paragraph)\b.*|(?:your\s+)?(?:abstract|text|content|title)\s+(?:goes\s+)?here|placeholder(?:\s+text)?)[.!]?$
    | \bhier\s+steht\s+später\b | \baquí\s+irá\s+el\s+(?:contenido|texto)\b | ^click\s+to\s+add\s+\w+$ | ^body\s+text(?:\s+body\s+text)+ | \b(?:asdf|qwer)(?:\s+(?:asdf|qwer|test))+\b | ^x{3,}(?:\s+x{3,})+$
    | 占位(?:文本|文字|符)?，?请替换 | (?:此处|这里)(?:为|是)(?:示例|占位)(?:文字|文本) | (?:正文|内容)+(?:待补|待填|待定)
    """,
    re.VERBOSE | re.IGNORECASE,
)

_STATUS = r"(?:bad\s+request|unauthorized|payment\s+required|forbidden|not\s+found|method\s+not\s+allowed|request\s+time-?out|conflict|gone|too\s+many\s+requests|internal\s+server\s+error|not\s+implemented|bad\s+gateway|service\s+(?:temporarily\s+)?unavailable|gateway\s+time-?out)"
#: Response statuses, as a page's own line.
STATUS = re.compile(rf"^(?:https?\s+)?(?:status|error|fehler|fehlercode|código|错误码?)?\s*(?:code)?[\s:：#]*[45]\d\d(?:\s*[-–—:]?\s*{_STATUS})?[.!]?$|^{_STATUS}[.!]?$", re.IGNORECASE)

#: Messages of error pages.
ERRORS = re.compile(
    r"""
    \bthe\s+requested\s+(?:url|page|resource)\b.{0,80}\bnot\s+found\b | ^an?\s+(?:unexpected\s+)?(?:error|exception)\s+occurred\b | ^(?:oops!?\s*)?something\s+went\s+wrong\b
    | ^(?:oops[!.]?|access\s+denied[.!]?)$ | ^sorry,\s+this\s+\w+\s+could\s+not\s+be\s+loaded | \bcan(?:'|’)?(?:no)?t\s+find\s+the\s+page\b | ^page\s+not\s+(?:found|available)
    | ^you\s+do\s+not\s+have\s+permission\s+to\s+(?:view|access) | ^your\s+session\s+has\s+expired | ^too\s+many\s+requests\s+from | ^the\s+(?:service|site|server)\s+is\s+(?:temporarily\s+)?(?:offline|unavailable|down)
    | ^(?:fatal|parse)\s+error:\s | ^traceback\b | ^(?:please\s+)?complete\s+the\s+check\b.*\brobot\b | ^checking\s+your\s+browser\b | ^verify\s+(?:that\s+)?you\s+are\s+(?:a\s+)?human
    | angeforderte\s+seite\s+wurde\s+nicht\s+gefunden | \bseite\s+(?:konnte\s+)?nicht\s+gefunden\b | ^zugriff\s+verweigert
    | \bno\s+se\s+pudo\s+cargar\b | ^página\s+no\s+encontrada | ^acceso\s+denegado
    | 页面不存在 | 服务器内部错误 | 没有权限(?:访问|查看) | 系统繁忙，请稍后 | 登录已过期 | ^错误码\s*\d+ | (?:加载|载入)失败。?$
    """,
    re.VERBOSE | re.IGNORECASE,
)

#: Notices that scripts are required.
NOTICES = re.compile(
    r"""
    \b(?:enable|activate|turn\s+on|switch\s+on|allow)\s+(?:javascript|scripts?|scripting|js)\b | \bneed\s+to\s+enable\b | \b(?:javascript|scripting|scripts?)\s+(?:is|are|has\s+been)\s+(?:disabled|blocked|off|turned\s+off|switched\s+off|needed|required)
    | \b(?:requires?|needs?)\s+(?:javascript|scripts?|js)\b | \bhas\s+scripting\s+turned\s+off\b | \bscripting\s+is\s+needed\b
    | \baktivieren\s+sie\s+(?:bitte\s+)?javascript\b | \bactiv[ea]r?\s+javascript\b | \bhabilit[ea]r?\s+javascript\b
    | (?:未启用|启用|开启|打开|允许)[^。]{0,8}(?:javascript|脚本) | (?:javascript|脚本)[^。]{0,4}(?:被禁用|已禁用|未启用|未开启)
    """,
    re.VERBOSE | re.IGNORECASE,
)

#: One of these is in every filler, error and notice that the patterns know, so that most segments need no pattern.
TRIGGERS = (
    "lorem dolor consectetur adipiscing exercitation ullamco eiusmod aliquip incididunt nostrud blindtext relleno dummy placeholder asdf qwer xxx here".split()
    + ["sample text", "hier steht", "aquí irá", "click to add", "body text", "占位", "示例", "待补", "待填", "待定"]
    + ["not found", "occurred", "went wrong", "oops", "access denied", "could not be loaded", "find the page", "permission to", "session has", "too many requests", "offline", "unavailable", "is down", "temporarily down"]
    + ["error:", "traceback", "robot", "your browser", "human", "nicht gefunden", "verweigert", "se pudo", "no encontrada", "denegado", "页面不存在", "服务器", "权限", "系统繁忙", "登录", "错误码", "失败"]
    + ["script", "need to enable", "脚本", "enable js", "activate js", "turn on js", "switch on js", "allow js", "require js", "requires js", "need js", "needs js"]
)
_SLOT_SIGN = re.compile(r"[{<\[【%_@]|XXXX|[?？]{2}|[(（](?:待|请|此处)")


@lru_cache(maxsize=1)
def _triggers():
    import ahocorasick

    machine = ahocorasick.Automaton()
    for word in TRIGGERS:
        machine.add_word(word, word)
    machine.make_automaton()
    return machine


#: Words and signs of which a segment without residue may have some; with one of them it is a near case.
_NEAR = re.compile(r"[{}<>\[\]【】$%_`]|\b(?:error|not found|denied|unavailable|http|script|scripts|javascript|placeholder|sample|permission|session|server)\b|脚本|错误|失败|占位|填", re.IGNORECASE)


def segments(text: str) -> list[str]:
    """Lines and sentences of a text, without list marks; nothing of it is left out."""
    return [s for s in (re.sub(r"^[\s\-*#>•]+", "", x).strip() for x in _CUT.split(text)) if s]


def bare(segment: str) -> str:
    """The segment in which what is quoted as notation is blanked, of the same length."""
    return _QUOTED.sub(lambda m: " " * len(m[0]), segment) if "`" in segment or "$" in segment else segment


def marked(segment: str) -> tuple[str, int, int] | None:
    """The kind of residue of a segment and where it stands in ``bare``; the exact check."""
    plain = bare(segment)
    if _SLOT_SIGN.search(plain) and (m := SLOTS.search(plain)):
        return "slot", *m.span()
    worded = next(_triggers().iter(re.sub(r"\s+", " ", plain.lower())), None) is not None
    if worded and (m := FILLER.search(plain)):
        return "filler", *m.span()
    if (m := STATUS.search(plain)) or worded and (m := ERRORS.search(plain)):
        return "error", *m.span()
    return ("notice", *m.span()) if worded and (m := NOTICES.search(plain)) else None


def residue(segment: str) -> str | None:
    """slot, filler, error or notice, if the segment is such."""
    found = marked(segment)
    return found[0] if found else None


# ---- the model ----


def _grams(texts: list[str]) -> tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray]:
    """Families of (feature number, position) over the texts laid out one after another, and where each text begins."""
    points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    lengths = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
    owner = np.repeat(np.arange(len(texts), dtype=np.int32), lengths)
    big, small = (points >= 65) & (points <= 90), (points >= 97) & (points <= 122)
    digit = (points >= 48) & (points <= 57)
    lower = np.where(big, points + 32, np.where(digit, 48, points)).astype(np.uint64)
    kind = np.where(small, 1, np.where(big, 2, np.where(digit, 3, np.where(points >= 0x2E80, 4, 0)))).astype(np.uint8)
    kind[(points >= 0x3000) & (points <= 0x303F) | (points >= 0xFF00)] = 0
    shape = np.where(kind > 0, kind, points).astype(np.uint64)
    keep = np.flatnonzero(np.r_[True, (kind[1:] != kind[:-1]) | (kind[1:] == 0) | (owner[1:] != owner[:-1])]) if len(points) else np.empty(0, np.int64)
    out = []

    def add(seq: np.ndarray, own: np.ndarray, place: np.ndarray | None, sizes: tuple[int, ...], salt: int) -> None:
        h = np.zeros(len(seq), dtype=np.uint64)
        for n in range(1, max(sizes) + 1):
            count = len(seq) - n + 1
            if count <= 0:
                return
            h = h[:count] * np.uint64(0x9E3779B97F4A7C15) + (seq[n - 1 :] + np.uint64(salt))
            if n in sizes:
                at = np.flatnonzero(own[:count] == own[n - 1 :])
                out.append(((mix(h[at] + np.uint64(n)) >> np.uint64(64 - BITS)).astype(np.int64), at if place is None else place[at]))

    add(lower, owner, None, (4, 7), 1 << 40)
    add(shape[keep], owner[keep], keep, (2, 3, 5), 1 << 41)
    return out, np.r_[0, np.cumsum(lengths)]


def _extra(size: np.ndarray, title: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Length, title and place features of segments, one row each."""
    each = ((1, np.log2(np.maximum(size, 1)).astype(np.int64)), (2, title), (3, place))
    return np.stack([(mix(x.astype(np.uint64) + np.uint64(salt << 50)) >> np.uint64(64 - BITS)).astype(np.int64) for salt, x in each], axis=1)


def framed(segment: str) -> str:
    return f"\n{bare(segment)}\n"


def margins(weights: np.ndarray, parts: list[str], title: np.ndarray, place: np.ndarray) -> np.ndarray:
    """The model's margin of each segment: that of its best window, so that no length dilutes it."""
    families, begin = _grams([framed(p) for p in parts])
    score = np.zeros(int(begin[-1]))
    for ids, at in families:
        score[at] += weights[ids]
    sums = np.r_[0.0, np.cumsum(score)]
    size = np.diff(begin)
    n = np.maximum(0, -(-(size - WINDOW) // STRIDE)) + 1
    first = np.r_[0, np.cumsum(n)[:-1]]
    start = np.minimum(np.repeat(begin[:-1], n) + (np.arange(n.sum()) - np.repeat(first, n)) * STRIDE, np.repeat(np.maximum(begin[:-1], begin[1:] - WINDOW), n))
    end = np.minimum(start + WINDOW, np.repeat(begin[1:], n))
    best = np.maximum.reduceat(sums[end] - sums[start], first)
    return best + EXTRA * weights[_extra(size - 2, title, place)].sum(axis=1) + weights[-1]


def fit(windows: list[str], labels: np.ndarray, size: np.ndarray, title: np.ndarray, place: np.ndarray, epochs: int = 10, rate: float = 0.3, l2: float = 1e-6) -> np.ndarray:
    """Weights of the logistic model over windows (the last is the bias), by adaptive gradient steps in a fixed order."""
    weights = np.zeros((1 << BITS) + 1)
    squares = np.full_like(weights, 1e-3)
    if not len(windows):
        return weights
    families, begin = _grams(windows)
    ids, at = np.concatenate([f[0] for f in families]), np.concatenate([f[1] for f in families])
    owner = np.searchsorted(begin, at, "right") - 1
    order = np.argsort(owner, kind="stable")
    ids, edges = ids[order], np.searchsorted(owner[order], np.arange(len(windows) + 1))
    extra = _extra(size, title, place)
    step = 256
    heavier = min(8.0, max(1.0, (labels == 0).sum() / max(1.0, labels.sum())))
    turn = np.argsort(mix(np.arange(len(windows), dtype=np.uint64)))
    for _ in range(epochs):
        for k in range(0, len(turn), step):
            chosen = turn[k : k + step]
            spans = [x for c in chosen for x in (ids[edges[c] : edges[c + 1]], extra[c])]
            sizes = (edges[chosen + 1] - edges[chosen]) + extra.shape[1]
            flat = np.concatenate(spans)
            ends = np.cumsum(sizes)
            scale = np.ones(len(flat))
            scale[(ends[:, None] - 1 - np.arange(extra.shape[1])).ravel()] = EXTRA
            sums = np.r_[0.0, np.cumsum(weights[flat] * scale)]
            margin = sums[ends] - sums[ends - sizes] + weights[-1]
            error = (1 / (1 + np.exp(-np.clip(margin, -30, 30))) - labels[chosen]) * np.where(labels[chosen] > 0, heavier, 1.0)
            seen, back = np.unique(flat, return_inverse=True)
            gradient = np.bincount(back, weights=np.repeat(error, sizes) * scale, minlength=len(seen)) / step + l2 * weights[seen]
            squares[seen] += gradient**2
            weights[seen] -= rate * gradient / np.sqrt(squares[seen])
            g = error.sum() / step
            squares[-1] += g * g
            weights[-1] -= rate * g / np.sqrt(squares[-1])
    return weights


def _laid_out(texts: list[str | None], titled: list[bool]) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
    """Segments of texts, the text each is of, and its title and place features."""
    parts: list[str] = []
    of, title, place = [], [], []
    for i, t in enumerate(texts):
        mine = segments(t or "")
        for k, s in enumerate(mine):
            parts.append(s)
            of.append(i)
            title.append(int(titled[i]))
            place.append(min(len(mine), 6) * 4 + (k == 0) * 2 + (k == len(mine) - 1))
    return parts, np.array(of, dtype=np.int64), np.array(title, dtype=np.int64), np.array(place, dtype=np.int64)


def weak_label(segment: str) -> tuple[str, int, int]:
    """positive, near (no residue, but words or signs of it) or plain, and where what says so begins and ends (-1: nothing does)."""
    found = marked(segment)
    if found:
        return "positive", found[1], found[2]
    m = _NEAR.search(segment)
    return ("near", *m.span()) if m else ("plain", -1, -1)


def _window(segment: str, middle: int, h: int) -> str:
    """The part of a segment that the model learns from: about its middle, or anywhere."""
    whole = framed(segment)
    room = len(whole) - WINDOW
    if room <= 0:
        return whole
    at = middle + 1 - WINDOW // 2 + h % STRIDE - STRIDE // 2 if middle >= 0 else h % (room + 1)
    at = min(max(0, at), room)
    return whole[at : at + WINDOW]


_LABELLED = "label string, window string, size int, title int, place int, host string, h long"


def _labelled(limit: dict[str, int]):
    """The segments of each label with the least hashes, not more of a task than of the whole sample."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[str, dict[int, tuple]] = {k: {} for k in limit}
        for batch in batches:
            texts, hosts = batch.column("text").to_pylist(), batch.column("host").to_pylist()
            titled = [bool(x and x.strip()) for x in batch.column("title").to_pylist()]
            parts, of, title, place = _laid_out(texts, titled)
            whole = [zlib.crc32((t or "").encode("utf-8", "surrogatepass")) for t in texts]
            for s, i, t, p in zip(parts, of, title, place):
                # an occurrence in a text counts, so that frequent segments are in the sample; copies of a text count once
                data = s.encode("utf-8", "surrogatepass")
                h = zlib.crc32(data, whole[i]) << 31 | zlib.adler32(data) >> 1
                # plain segments abound: a quarter of them, chosen by hash, has the least hashes of them all
                label, begin, end = weak_label(s)
                if label == "plain" and h >> 61:
                    continue
                kept[label].setdefault(h, (_window(s, (begin + end) // 2, h), len(s), int(t), int(p), hosts[i], h))
                if label == "positive":  # once more without its context, which should not decide
                    kept[label].setdefault(h ^ 1, (framed(bare(s)[begin:end]), end - begin, int(t), int(p), hosts[i], h ^ 1))
            for k, rows in kept.items():
                if len(rows) > 4 * limit[k]:
                    kept[k] = dict(sorted(rows.items())[: limit[k]])
        rows = [(k, *row) for k, mine in kept.items() for _, row in sorted(mine.items())[: limit[k]]]
        names = ("label", "window", "size", "title", "place", "host", "h")
        kinds = (pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.int64())
        columns = list(zip(*rows)) if rows else [()] * len(names)
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=list(names))

    return run


class Model:
    """Weights, the margin from which a segment is taken, and how it did on unseen hosts."""

    def __init__(self, weights: np.ndarray, least: float, report: dict[str, float]):
        self.weights, self.least, self.report = weights.astype(np.float32), least, {k: float(v) for k, v in report.items()}


def _is_held_out(host: str | None) -> bool:
    return zlib.crc32((host or "").encode()) % HELD_OUT == 0


def train(documents: DataFrame, *, doc_id: str = "doc_id", text: str = "text", title: str = "title", host: str = "source", sample: dict[str, int] = SAMPLE, sample_documents: int = SAMPLE_DOCUMENTS, keep: float = 0.999, slack: float = 1.0) -> Model:
    """Fits the model on windows of at most ``sample`` labelled segments, of about ``sample_documents`` documents at most.

    The margin from which a segment is taken keeps the part ``keep`` of the
    weakly positive segments of the held-out hosts (of the fitted ones, where no
    host is held out), less ``slack`` and 20 by the root of their number: the
    fewer there are, the less their least margin says.
    """
    rows = documents.where(F.col(doc_id).isNotNull() & F.col(text).isNotNull())
    one_in = max(1, rows.count() // sample_documents)
    rows = rows.where(F.pmod(F.xxhash64(F.col(doc_id)), F.lit(one_in)) == 0).select(F.col(text).alias("text"), F.col(title).cast("string").alias("title"), F.col(host).cast("string").alias("host"))
    drawn = rows.mapInArrow(_labelled(sample), _LABELLED)
    found = _draw(drawn, sample)
    if not any(r["label"] == "positive" for r in found):
        return Model(np.zeros((1 << BITS) + 1), float("-inf"), {"fitted": 0.0})
    windows = [r["window"] for r in found]
    labels = np.array([r["label"] == "positive" for r in found], dtype=np.float64)
    size, titles, places = (np.array([r[k] for r in found]) for k in ("size", "title", "place"))
    unseen = np.array([_is_held_out(r["host"]) for r in found])
    use = np.flatnonzero(~unseen)
    if not labels[use].any():
        use = np.arange(len(windows))
    weights = fit([windows[i] for i in use], labels[use], size[use], titles[use], places[use])
    families, begin = _grams(windows)
    score = np.zeros(int(begin[-1]))
    for ids, at in families:
        score[at] += weights[ids]
    sums = np.r_[0.0, np.cumsum(score)]
    margin = sums[begin[1:]] - sums[begin[:-1]] + EXTRA * weights[_extra(size, titles, places)].sum(axis=1) + weights[-1]
    judged = unseen if labels[unseen].any() else ~unseen
    good = np.sort(margin[judged & (labels == 1)])
    least = float(good[int((1 - keep) * len(good))]) - slack - 20 / np.sqrt(len(good))
    taken = margin[judged] > 0
    true = labels[judged] == 1
    hits = float((taken & true).sum())
    near = margin[judged & (labels == 0)]
    report = {"fitted": float(len(use)), "unseen": float(judged.sum()), "precision": hits / max(1.0, float(taken.sum())), "recall": hits / max(1.0, float(true.sum())), "margin": least, "negatives_taken": float((near >= least).mean()) if len(near) else 0.0}
    return Model(weights, least, report)


def _fewest(limit: dict[str, int]):
    """The rows of each label with the least hashes, of one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[str, dict[int, dict]] = {k: {} for k in limit}
        for batch in batches:
            for row in batch.to_pylist():
                kept[row["label"]].setdefault(row["h"], row)
            for k, rows in kept.items():
                if len(rows) > 4 * limit[k]:
                    kept[k] = dict(sorted(rows.items())[: limit[k]])
        rows = [row for k, mine in kept.items() for _, row in sorted(mine.items())[: limit[k]]]
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=batch.schema)

    return run


def _draw(drawn: DataFrame, sample: dict[str, int], groups: int = 8) -> list:
    """The sample: the least hashes of each label over all tasks, in two levels."""
    fewer = drawn.withColumn("group", F.expr(f"pmod(h, {groups})")).repartition("group").drop("group").mapInArrow(_fewest(sample), _LABELLED)
    out: list = []
    rows = fewer.collect()  # at most groups times the sample
    for label, n in sample.items():
        out += sorted((r for r in rows if r["label"] == label), key=lambda r: r["h"])[:n]
    return out


def residue_documents(documents: DataFrame, model: Model | None = None, *, doc_id: str = "doc_id", text: str = "text", title: str = "title", host: str = "source", checked: bool = True) -> DataFrame:
    """(doc_id, kinds, segments, share): documents with a segment that the model takes and the exact check upholds.

    The model (fitted on ``documents`` if none is given) scores every segment of
    every text by its best window and takes those at its margin or above; of
    these the exact check lets go what is none, and names the kind.  Without
    ``checked`` the model decides alone, at margin 0, and its kind is ``residue``.
    share is the part of the document's characters in such segments.  A null
    text has none; rows of a null id are left out.  Other columns are not touched.
    """
    of_type = dict(documents.dtypes)[doc_id]
    model = model or train(documents, doc_id=doc_id, text=text, title=title, host=host)
    known = documents.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted = known.value
        least = fitted.least if checked else 0.0
        for batch in batches:
            texts = batch.column("text").to_pylist()
            titled = [bool(x and x.strip()) for x in batch.column("title").to_pylist()]
            for a, b in slices(texts, 400_000):
                parts, of, titles, places = _laid_out(texts[a:b], titled[a:b])
                if not parts:
                    continue
                found: dict[int, list[tuple[str, int]]] = {}
                for k in np.flatnonzero(margins(fitted.weights, parts, titles, places) >= least).tolist():
                    if kind := residue(parts[k]) if checked else "residue":
                        found.setdefault(int(of[k]), []).append((kind, len(parts[k])))
                total = np.bincount(of, weights=[len(p) for p in parts], minlength=b - a)
                at = sorted(found)
                yield pa.RecordBatch.from_pydict({
                    "doc_id": batch.column("doc_id").slice(a, b - a).take(pa.array(at, pa.int64())),
                    "kinds": pa.array([sorted({k for k, _ in found[i]}) for i in at], pa.list_(pa.string())),
                    "segments": pa.array([len(found[i]) for i in at], pa.int32()),
                    "share": pa.array([sum(n for _, n in found[i]) / total[i] for i in at], pa.float64()),
                })

    rows = documents.where(F.col(doc_id).isNotNull() & F.col(text).isNotNull()).select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.col(title).cast("string").alias("title"))
    return rows.mapInArrow(run, f"doc_id {of_type}, kinds array<string>, segments int, share double").dropDuplicates(["doc_id"])
