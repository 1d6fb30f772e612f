"""Template residue, filler and error pages in documents, by linear classifiers trained on weak labels."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StructField, StructType

from cordonlake.llm.words import mix64, word_hashes
from cordonlake.llm.linear import Features, Hashed, LinearModel, hash_sample

LINE_LABELS, MARK_LABELS = ["notice", "filler"], ["placeholder"]

# Reason phrases of the HTTP status codes from 400 on.
STATUS = ("bad request|unauthorized|payment required|forbidden|not found|method not allowed|not acceptable|request timeout|conflict|gone|length required|precondition failed|payload too large|"
          "unsupported media type|too many requests|internal server error|not implemented|bad gateway|service unavailable|gateway timeout")  # fmt: skip

# The words of the usual Latin filler.
LATIN = "lorem|ipsum|dolor|amet|elit|aliqua|veniam|nostrud|fugiat|pariatur|cillum|mollit|laborum|tempor|consectetur|adipiscing"

# Weak labels: what a message of a server or viewer speaks of, by kind. A phrase marks a line; a line with prose around a phrase is marked as good.
NOTICES = {
    "status": rf"""^\W*(?:http/[\d.]+\s+)?(?:error\s+)?[45]\d\d\W+(?:{STATUS})|\b(?:status|code|error)["']?\s*[:>]\s*["']?(?:[45]\d\d\b|{STATUS})|^http/[\d.]+ \d|^(?:retry-after|content-(?:length|type)|cache-control|connection|server|date|x-[\w-]+): ?\S+$""",
    "program": r"""^traceback|^\s*file ".*", line \d|^\w*(?:error|exception):\s|fatal error|stack trace|^warning: \w+\(|failed to (?:open stream|start|load)""",
    "missing": r"""find (?:that|this|the) (?:page|file|document)|(?:page|site|document|filing|file|link|resource).{0,30}(?:not (?:be )?found|no longer|does not exist|never existed|(?:has )?moved|unavailable)""",
    "access": r"""(?:access|permission).{0,20}(?:denied|blocked|refused)|(?:log|sign) ?in (?:required|again|to)|session (?:has )?expired""",
    "script": r"""(?:enable|turn on|activate|allow|requires?|needs?|without)\W.{0,30}(?:java ?script|script(?:s|ing)?\b|client-side|cookies)|(?:javascript|scripts?|cookies|active content) (?:is |are )?(?:required|disabled|turned off|off)\b|browser.{0,40}(?:support|does not run|block)|\bblocker\b""",
    "load": r"""captcha|not a robot|too many requests|try again (?:later|in)|temporarily (?:offline|unavailable)|maintenance|be back (?:soon|shortly)""",
    "network": r"""(?:could|can) ?not (?:connect|be (?:reached|loaded))|connection.{0,30}(?:reset|refused|timed out)|(?:name|host|dns) lookup|certificate.{0,40}(?:expired|invalid|not trusted|run out)|database connection|something went wrong|unexpected (?:error|problem)""",
    "abroad": r"""nicht gefunden|zugriff verweigert|javascript aktivieren|aktivieren sie|introuvable|accès refusé|activer javascript|no encontrada|acceso denegado|active javascript""",
}
_NOTICE = re.compile("|".join(NOTICES.values()), re.I)
# A word or two over and over, a sentence that comes again in its paragraph.
_AGAIN = r"\b(\w+(?: \w+)?)(?:[\s,.]+\1\b){5}|(?:^|[.!?] )([A-Z][^.\n]{12,80}\.) (?:[^\n]{0,200} )?\2"
_FILLERS = (
    rf"lorem ipsum|(?:\b(?:{LATIN})\b.*){{3}}|(?:[asdfghjkl]{{4,}}\s+){{4}}|(?:qwer|asdf|zxcv)\w*\s+(?:\w*(?:qwer|asdf|zxcv|hjkl|sdfg)\w*\s*){{2}}",
    r"\bdummy (?:line|word|text)s?\b|\bmock-?up\b|(?:your|sample|dummy|filler|placeholder|example) (?:text|copy|paragraph|content)\b|(?:text|copy|paragraph|content)\b.{0,40}\b(?:goes here|to be replaced|will follow|to come)\b|blindtext|faux texte|texto de relleno",
)
_FILLER = re.compile("|".join([_FILLERS[0], _AGAIN, _FILLERS[1]]), re.I | re.S)
# Signs that a placeholder opens with, for the search of rows to learn from.
_OPENED = r"\{\{|<%|\[(?:insert|tbd)|todo:|%%|__[a-z]|_here>|\{0\}|\$\{|\[[●•]"
# Looser forms for RE2, which reads a text once: wherever a phrase matches, one of these does. Borders of words and lines are left out; repetitions, which RE2 lacks, are not covered.
_LOOSE = ["(?is)" + p.replace(r"\b", "").replace("^", "").replace(r"\S+$", r"\S+").replace(r"\s", r"[\s\x0b]") for p in (*NOTICES.values(), *_FILLERS, _OPENED)]
_PROSE = re.compile(r"\b(?:shall|must|may|will|agrees? to|plans? to|expects? to|such as|for example|where the)\b", re.I)

#: Anything that could stand for a value to be filled in; the classifier decides.
_MARK = re.compile(
    r"\{\{.+?\}\}|\{%.+?%\}|<%.+?%>|[$#]\{.+?\}|%%\w{2,30}%%|%\(\w{2,30}\)s?|%\w{2,30}%|@@\w{2,30}@@|@\w{2,30}@|__[A-Za-z]\w{0,30}?__|~[A-Z]\w{1,30}~|\[\[.+?\]\]|<<.+?>>|«[^»\n]+»|\$?\[[^\[\]\n]+\]|<!--.+?-->|<[A-Za-z][\w :-]+>|\{\w*\}"
    r"|\b(?i:TODO|TBD|TBC|FIXME|XXX)\b:?(?: \w+){0,4}|\bX{2,}(?:[/.-]X{2,})+(?:[/.-]\d*X+)?|\bX{2,}\b|\((?i:enter|insert|fill in|name of|your) [^()\n]+\)|\[?[●•]\]?|_{3,}"
)
_SURE_MARK = re.compile(
    r"\{\{.*\}\}|\{%.*%\}|<%.*%>|%%\w+%%|%\(\w+\)s?|@@\w+@@|\[\[[A-Za-z_ ]+\]\]|<<[A-Za-z_ ]+>>|\[(?:insert|enter|tbd|todo|name of|your|date of)\b.*\]|\((?:enter|insert)\b.*\)|(?:TODO|FIXME):.*|<\w+_here>|<!-- .*missing.*-->|\[[●•]\]|XX/XX/(?:20)?XX(?:XX)?|__[A-Z_]+__|\{\d\}|[$#]\{\w+\}",
    re.I,
)
_ABOUT = re.compile(r"\b(?:variable|template|ends (?:with|in)|stands for|expands|called|marked|notation|syntax|written as|literal|note|table|code|command|fields?|reads|withheld|omitted|left out|confidential|redacted|signature|signed|dated|element|tag|such as)\b", re.I)
_NOT_MARK = re.compile(r"^_{3,}$|^\[\d+\]$|^<\d+>$|^\[\*+\]$|^\[(?:redacted|omitted|sic|\.\.\.|…)\]$|^\{\}$", re.I)
# Marks put into sample lines where a sample has fewer than so many that are sure, so that the classifier knows both sides.
MADE_BELOW = 50
MADE_MARKS = [("{{ name }}", 1.0), ("[insert date]", 1.0), ("<% owner %>", 1.0), ("TODO: amount", 1.0), ("[Name of the party]", 1.0), ("~TITLE~", 1.0), ("[_owner_]", 1.0), ("%%DATE%%", 1.0),
              ("__________", 0.0), ("[12]", 0.0), ("[***]", 0.0), ("[omitted]", 0.0)]
_WORD = re.compile(r"[^\W\d_]+|\d+")
_LINE = re.compile(r"[^\n\f\r]+")


_SERVER = re.compile(r"[a-z][\w.-]*(?:/\d[\w.]*)?", re.I)
#: No mark is without one of these, in lower case; a text without them is not searched.
_HINTS = ("{", "<", "@", "~", "«", "[", "●", "•", "#{", "__", "todo", "tbd", "tbc", "fixme", "xx", "(enter", "(insert", "(fill in", "(name of", "(your", "%%", "%(")
_PERCENT = re.compile(r"%\w{2,30}%")


def _marks(text: str) -> Iterator[re.Match]:
    """Matches of what could be a placeholder, by line."""
    low = text.lower()
    if any(h in low for h in _HINTS) or ("%" in text and _PERCENT.search(text)):
        yield from _MARK.finditer(text)


def lines_of(text: str) -> list[str]:
    return [x for x in (m.strip() for m in _LINE.findall(text)) if x]


_BITS = 16
_DIGITS = bytes.maketrans(b"123456789", b"000000000")
_KEYS = np.zeros((256, 256), bool)  # letters next to each other on a keyboard's row
for _row in ("qwertyuiop", "asdfghjkl", "zxcvbnm"):
    for _a, _b in zip(_row, _row[1:]):
        _KEYS[ord(_a), ord(_b)] = _KEYS[ord(_b), ord(_a)] = True


def line_features(lines: list[str], first: np.ndarray) -> Hashed:
    """Hashed features of lines, ``first`` marks those that open a text: words and pairs of words, the words that a line, a
    title and the line before begin with, signs, length, repetition, and how far it runs along keyboard rows."""
    with np.errstate(over="ignore"):
        n = len(lines)
        words, offsets = word_hashes("\n".join(lines).encode("utf-8", "replace").translate(_DIGITS).decode().split("\n") if n else [])
        line = np.repeat(np.arange(n), np.diff(offsets))
        size = np.diff(offsets)
        place = np.arange(len(words)) - offsets[line]
        at, value, row = [], [], []

        def add(kind: int, keys: np.ndarray, v: np.ndarray | float, r: np.ndarray) -> None:
            at.append((mix64(keys.astype(np.uint64) * np.uint64(2654435761) + np.uint64(kind)) & np.uint64((1 << _BITS) - 1)).astype(np.int64))
            value.append(np.broadcast_to(np.asarray(v, float), len(keys)))
            row.append(r)

        scale = 1.5 / np.sqrt(1.0 + size)
        add(1, words, scale[line], line)
        pair = np.flatnonzero(line[1:] == line[:-1])
        add(2, words[pair] * np.uint64(3) ^ mix64(words[pair + 1]), scale[line[pair]], line[pair])
        opens = place < 4
        add(3, words[opens], 0.5, line[opens])
        title = (place < 8) & first[line]
        add(4, words[title], 0.3, line[title])
        follows = (place < 3) & (line + 1 < n) & ~np.append(first, True)[line + 1]
        single = np.append(size, 0)[line + 1] <= 2  # the line after is a word or two
        add(5, words[follows] * np.uint64(2) + single[follows], 0.7, line[follows] + 1)
        every = np.arange(n)
        add(6, np.minimum(size // 8, 8), 0.5, every)
        add(7, np.minimum(size, 3), 0.5, every)
        add(8, first, 0.2, every)
        # a batch has far fewer than 2^24 lines, and 40 bits tell the words of a line apart
        kinds = (np.unique(line.astype(np.uint64) << np.uint64(40) | words >> np.uint64(24)) >> np.uint64(40)).astype(np.int64)
        share = np.bincount(kinds, minlength=n) / np.maximum(1, size)
        long = size >= 8
        add(9, np.zeros(long.sum()), 4 * np.maximum(0, 0.6 - share[long]), every[long])
        data = np.frombuffer("\n".join(lines).lower().encode("utf-8", "replace") + b"\n", np.uint8)
        of = np.cumsum(data == 10) - (data == 10)
        sign = (data > 32) & (data < 127) & ~((data >= 48) & (data < 58)) & ~((data >= 97) & (data < 123)) & (data != 46) & (data != 44)
        signs = np.unique(of[sign] * 256 + data[sign])
        add(10, signs % 256, 0.5, signs // 256)
        letter = (data >= 97) & (data < 123)
        both = letter[1:] & letter[:-1]
        near = both & _KEYS[data[1:], data[:-1]]
        run = np.bincount(of[1:][near], minlength=n)[:n] / np.maximum(1, np.bincount(of[1:][both], minlength=n)[:n])
        add(11, np.zeros(n), 5 * np.maximum(0, run - 0.3), every)
        return Hashed(np.concatenate(at), np.concatenate(value), np.concatenate(row).astype(np.int64), n)


def mark_features(text: str, start: int, end: int) -> Features:
    """Features of something that could be a placeholder: its signs, shape and words, and the words around it."""
    mark = text[start:end]
    shape = re.sub(r"[A-Z]+", "A", re.sub(r"[a-z]+", "a", re.sub(r"\d+", "0", mark)))
    left, right = text[max(0, start - 60) : start], text[end : end + 60]
    left, right = left.rsplit("\n", 1)[-1], right.split("\n", 1)[0]
    f: Features = {"mark": 1.0, "shape:" + shape[:24]: 1.5, "signs:" + re.sub(r"[\w\s]+", "x", mark)[:16]: 2.0}
    f |= {"in:" + w.lower(): 0.5 for w in _WORD.findall(mark)[:6]}
    f |= {"before:" + w.lower(): 1.0 for w in _WORD.findall(left)[-3:]}
    f |= {"after:" + w.lower(): 1.0 for w in _WORD.findall(right)[:3]}
    f["about"] = 3.0 * bool(_ABOUT.search(left[-40:])) + 1.5 * bool(_ABOUT.search(right[:30]))
    f[f"joined={text[start - 1 : start].strip() != ''}{right[:1].strip() != ''}"] = 0.5
    f["quoted"] = float(text[max(0, start - 1) : start] in tuple("\"'“‘`/") or right[:1] in tuple("\"'”’`/"))
    return f


_READER = re.compile(r"\b(?:you|your|we|please|sie|votre|vous|veuillez|su)\b", re.I)
_MENTION = re.compile(r"\b(?:such as|for example|e\.g\.|refers? to|means|counts as)", re.I)


def _weak_line(line: str) -> tuple[list[float], list[float]]:
    """Label and certainty of (notice, filler). A phrase amid prose that does not speak to the reader is left open, if short."""
    head = line[:600]
    filler = bool(_FILLER.search(head))
    notice = not filler and bool(_NOTICE.search(head))
    if notice and (_MENTION.search(head) or len(line) > 400):
        return [0.0, 0.0], [1.0, 1.0]
    if notice and _PROSE.search(head) and not _READER.search(head):
        return [0.0, 0.0], [0.0, 1.0]
    return [float(notice), float(filler)], [1.0, 1.0]


def _weak_mark(text: str, start: int, end: int) -> tuple[float, float]:
    mark, left = text[start:end], text[max(0, start - 40) : start].rsplit("\n", 1)[-1]
    right = text[end : end + 30].split("\n", 1)[0]
    if _NOT_MARK.search(mark) or _ABOUT.search(left) or re.match(r"\s*(?:names|stands|expands|means|denotes|,? after which|(?:was|were) left)\b", right) or left.endswith(("/", '"', "“")):
        return 0.0, 1.0
    return (1.0, 1.0) if _SURE_MARK.fullmatch(mark) else (0.0, 0.0)


class ResidueModel:
    """Classifiers of lines and of marks, fitted on weak labels; ``quality`` is measured on hosts left out of the fit."""

    def __init__(self, sample: pd.DataFrame):
        """``sample``: ``text`` and ``host``; a fifth of the hosts is held out."""
        lines, first, y, sure, held, marks, m_y, m_held, made = [], [], [], [], [], [], [], [], []
        seen: set[tuple[str, str]] = set()
        for text, host in zip(sample["text"], sample["host"]):
            out = sum(str(host).encode()) % 5 == 0
            own, noted = lines_of(text), False
            for i, line in enumerate(own):
                label, certain = _weak_line(line)
                if noted and _SERVER.fullmatch(line):  # what a server puts below its status
                    label = [1.0, 0.0]
                noted = label[0] > 0
                if (own[i - 1] if i else "", line) not in seen:
                    seen.add((own[i - 1] if i else "", line))
                    # a line is learnt together with the one before it, as its features need
                    lines += own[max(0, i - 1) : i + 1]
                    first += [True] * min(1, i) + [i == 0]
                    y += [[0.0, 0.0]] * min(1, i) + [label]
                    sure += [[0.0, 0.0]] * min(1, i) + [certain]
                    held += [out] * (min(1, i) + 1)
            if own and len(made) < 400:
                line, (mark, label) = max(own, key=len)[:400], MADE_MARKS[len(made) % len(MADE_MARKS)]
                at = line.find(" ", len(line) // 2) + 1
                made.append((line[:at] + mark + " " + line[at:], at, at + len(mark), label, out))
            for m in _marks(text):
                label, certain = _weak_mark(text, m.start(), m.end())
                if certain:
                    marks.append(mark_features(text, m.start(), m.end()))
                    m_y.append([label])
                    m_held.append(out)
        for text, start, end, label, out in made if len(marks) < MADE_BELOW else []:
            marks.append(mark_features(text, start, end))
            m_y.append([label])
            m_held.append(out)
        self.quality: dict[str, float] = {}
        self.lines = self._fit(LINE_LABELS, line_features(lines, np.array(first, bool)), y, sure, held)
        self.marks = self._fit(MARK_LABELS, Hashed.of(marks, _BITS), m_y, np.ones((len(m_y), 1)), m_held)

    def _fit(self, labels: list[str], x: Hashed, y: list, sure: list, held: list) -> LinearModel:
        model = LinearModel(labels, bits=_BITS, rounds=100)
        if not x.rows:
            model.thresholds[:] = 1.1
            return model
        y, sure, held = np.array(y), np.array(sure), np.array(held, bool)
        model.fit(x.take(~held), y[~held], sure[~held])
        if held.any():
            self.quality |= model.calibrate(x.take(held), y[held], sure[held])
        return model

    def judge(self, texts: list[str]) -> pd.DataFrame:
        """Per text: placeholders, filler paragraphs, and the share of its characters in notices."""
        lines, owner, first, marks, mark_owner = [], [], [], [], []
        for i, text in enumerate(texts):
            own = lines_of(text)
            lines += own
            owner += [i] * len(own)
            first += [True] + [False] * (len(own) - 1) if own else []
            for m in _marks(text):
                marks.append(mark_features(text, m.start(), m.end()))
                mark_owner.append(i)
        n, size = len(texts), np.array([len(x) for x in lines], float)
        p = self.lines.scores(line_features(lines, np.array(first, bool))) >= self.lines.thresholds
        q = self.marks.scores(marks)[:, 0] >= self.marks.thresholds[0]
        words = np.array([x.count(" ") + 1 for x in lines], int)
        notice, filler = p[:, 0] & ~p[:, 1], p[:, 1] & (words >= 5)
        count = lambda o, w: np.bincount(np.asarray(o, np.int64), w, minlength=n)
        return pd.DataFrame({
            "placeholders": count(mark_owner, q.astype(float)).astype(np.int32), "fillers": count(owner, filler.astype(float)).astype(np.int32),
            "notice_share": count(owner, size * notice) / np.maximum(1, count(owner, size)),
        })


def fitted(df: DataFrame, id_col: str, text_col: str, host_col: str, sample_rows: int = 4000, sample_chars: int = 50_000, seed: int = 3) -> ResidueModel | None:
    """The model of :func:`residue` for a table, None for one without texts.

    At most ``sample_rows`` rows, those of the smallest hash of the id; up to a third of them are rows whose text one of the weak phrases marks,
    looked for among twelve times as many rows of the smallest hash only, a slice of the hash after the other until there are enough. Rows over ``sample_chars`` characters are not taken.
    """
    rows = _texts(df, id_col, text_col, host_col).where(F.length("text") <= sample_chars)
    plain = hash_sample(rows, "id", sample_rows - sample_rows // 3, seed)
    if not len(plain):
        return None
    marked = _marked(rows, sample_rows // 3, 12 * sample_rows, seed + 1)
    return ResidueModel(pd.concat([plain, marked]).drop_duplicates("id"))


def _marked(rows: DataFrame, n: int, among: int, seed: int) -> pd.DataFrame:
    """The ``n`` rows of the smallest hash of the id whose text a weak phrase marks, looked for among about ``among`` rows of the smallest hash.

    Patterns are what costs, so they are tried on a slice of the hash at a time: first three times ``n`` rows, then what the share of marked ones
    calls for and a fifth more, last what is left. Of a slice they are tried only on texts that have a looser form of one of them (``_LOOSE``), which a
    search in linear time finds, or a repetition. Slices follow each other in the hash, so the rows are those that one pass would give.
    """
    total, h = rows.count(), F.xxhash64(F.col("id").cast("string"), F.lit(seed))
    text = F.col("text")
    hint = text.rlike("(?im)" + _NOTICE.pattern) | text.rlike("(?is)" + _FILLER.pattern) | text.rlike("(?i)" + _OPENED)

    def looked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            may = reduce(pc.or_, (pc.match_substring_regex(b.column("text"), p) for p in _LOOSE))
            yield pa.RecordBatch.from_arrays([*b.columns, may], [*b.schema.names, "may"])

    end = 1.0 if total <= among else among / total
    found: list[pd.DataFrame] = []
    done, held, upto = 0.0, 0, min(end, 3 * n / max(1, total))
    for last in (False, False, True):
        upto = end if last else upto
        low, high = (int(-(2**63) + 2**64 * share) for share in (done, upto))
        part = rows.where(h >= F.lit(low)) if upto == 1 else rows.where((h >= F.lit(low)) & (h < F.lit(high)))
        may = part.mapInArrow(looked, StructType([*part.schema.fields, StructField("may", BooleanType())]))
        found.append(may.where((F.col("may") | text.rlike("(?is)" + _AGAIN)) & hint).drop("may").orderBy(h, "id").limit(n - held).toPandas())
        held, done = held + len(found[-1]), upto
        if held >= n or done >= end:
            break
        upto = min(end, 1.2 * n / held * done) if held else end
    return pd.concat([f for f in found if len(f)] or found[:1])


def _texts(df: DataFrame, id_col: str, text_col: str, host_col: str) -> DataFrame:
    return df.where(F.col(id_col).isNotNull() & F.col(text_col).rlike(r"\S")).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(host_col).cast("string").alias("host"))


def residue(df: DataFrame, id_col: str, text_col: str, host_col: str, model: ResidueModel | None = None, **fit) -> DataFrame:
    """``id, placeholders, fillers, notice_share, is_residue`` of every row with a text that is not blank.

    The classifiers are fitted on a bounded sample (:func:`fitted`) and applied to every row's whole text, where it is read. Lines and possible
    placeholders are classified; what a document is follows by rule: any placeholder, any filler line of five words or more, or notices over half of
    its characters.

    Args:
        df: other columns are ignored. Rows with a null id, a null or a blank text give no row; ``host_col`` may be null.
            Repeated rows give repeated results.
        model: from :func:`fitted`; fitted here if not given.
    """
    spark = df.sparkSession
    rows = _texts(df, id_col, text_col, host_col)
    schema = f"id {dict(rows.dtypes)['id']}, placeholders int, fillers int, notice_share double"
    model = model or fitted(df, id_col, text_col, host_col, **fit)
    if model is None:
        return spark.createDataFrame([], schema + ", is_residue boolean")
    shared = spark.sparkContext.broadcast(model)

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for lo in range(0, len(pdf), 1000):
                part = pdf.iloc[lo : lo + 1000]
                out = shared.value.judge(part["text"].tolist())
                out.insert(0, "id", part["id"].to_numpy())
                yield out

    found = rows.select("id", "text").mapInPandas(judge, schema)
    return found.withColumn("is_residue", (F.col("placeholders") > 0) | (F.col("fillers") > 0) | (F.col("notice_share") > 0.5))
