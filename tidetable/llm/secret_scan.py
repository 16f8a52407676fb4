"""Secret scans: fixed patterns, and strings that a primed compressor finds new.

Base patterns report assignments, access keys and long hexadecimal runs. Beyond those, every
token-like string in a sensitive context (a word like "key" or "auth" before it on its line, in
its own head, as in AUTH=value, or on the line before, and all through a private key block) is compressed with zstandard, primed with a dictionary of code identifiers and the text
around the string; one whose marginal compressed size stays near that of a random string of its
length and alphabet says nothing that its surroundings say, and is reported.

Texts are screened in bulk first (Arrow's linear-time regular expressions, exact: a text that
passes none has no span), and only the rest is searched value by value.
"""

from __future__ import annotations

import random
import re
import string
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import as_string, release, row_slices, table, tidied, unused

KINDS = ("assign", "access", "hex", "novel")
_KEYWORD = r"(password|passwd|secret|token|api_?key)"
_ASSIGN = re.compile("(?a:(?i:" + _KEYWORD + r")[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+))")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{32,}")
#: Screens: each matches every text in which the pattern of the same kind can match.
_SCREEN = (r"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?[A-Za-z0-9+/_.=-]{8}", r"AKIA[A-Z0-9]{12}", r"[0-9a-f]{32}")
CONTEXT_WORD = r"(?i:key|token|secret|passw|pwd|auth|credential|private|bearer|signature|session|cookie)"
_CANDIDATE = r"[A-Za-z0-9+/_=.-]{16,}"
_CONTEXT = re.compile(CONTEXT_WORD)
_TOKEN = re.compile(_CANDIDATE)
_LINE = re.compile(r"[^\n]+")
#: What a line that is one token may have around it; the lines around a private key.
_MARKS = string.punctuation + string.whitespace
_BEGIN, _END = re.compile(r"-----BEGIN [^\n]*PRIVATE KEY"), re.compile(r"-----END ")
#: A name with its '=' before a value; the end of a head; runs after it that are no words: long ones, or with letters and digits in turn.
_ASSIGNED = re.compile(r"[-./]*[A-Za-z_][A-Za-z0-9_./-]*=(?=[^=])")
_HEAD_END = re.compile(r"[-_./=]+")
_LONG, _MIXED = re.compile(r"[A-Za-z0-9]{8,}"), re.compile(r"[A-Za-z][0-9]+[A-Za-z]|[0-9][A-Za-z]+[0-9]")
#: Identifiers and file parts that code is full of: strings made of these are not new.
IDENTIFIERS = (
    "import from return function class public private static const let var def self this null true false string int float "
    "config settings environment environ process.env os.environ get_secret getenv password_hash token_type access_token refresh_token api_key "
    "client_id client_secret authorization Bearer Basic http https www com org net html json yaml xml index main test example sample placeholder "
    "username user_name email localhost 127.0.0.1 0000000000000000 1234567890 abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ ---------------- ================ "
    "your_api_key_here changeme xxxxxxxxxxxxxxxx src/main/java/com/example node_modules/package.json "
)

#: An identifier by its form; reported only as the value of a name that says secret.
_UUID = re.compile(r"[0-9A-Fa-f]{8}(?:-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}")
_SECRET_NAME = re.compile(r"(?i:(?:key|token|secret|passw\w*|pwd|credential\w*|auth|bearer)[\"']?\s*(?:[:=]|\s)\s*[\"']?$)")

#: Alphabets that secrets are written in, small ones first.
_ALPHABETS = tuple(
    (a, frozenset(a))
    for a in (
        string.digits,
        "0123456789abcdef",
        "0123456789ABCDEF",
        string.ascii_lowercase,
        string.ascii_uppercase,
        "abcdefghijklmnopqrstuvwxyz234567",
        "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567",
        string.digits + string.ascii_lowercase,
        string.digits + string.ascii_uppercase,
        string.ascii_letters,
        string.digits + string.ascii_letters,
    )
)
_RUN = re.compile(r"(?<![A-Za-z0-9])0[xX]|[A-Za-z0-9]+")
#: zstandard stores shorter strings as they are; longer ones are entropy-coded, so that a small alphabet takes less than its bytes.
CODED = 63


def _alphabet(value: str, share: float = 0.95) -> str:
    """The smallest alphabet that holds at least `share` of the characters: a prefix of a few others makes none larger."""
    return next(a for a, members in _ALPHABETS if sum(c in members for c in value) >= share * len(value))


def twin(value: str) -> str:
    """A random string of the same length and alphabets: runs of 16 or more letters and digits have their own, shorter ones that of all."""
    draw, runs = random.Random(len(value)), [m.group() for m in _RUN.finditer(value)]
    common = _alphabet("".join(r for r in runs if r not in ("0x", "0X")))

    def drawn(m: re.Match) -> str:
        return "".join(draw.choices(_alphabet(m.group()) if len(m.group()) >= 16 else common, k=len(m.group())))

    return _RUN.sub(drawn, value)


_PIECE = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_CONSONANTS = re.compile(r"[b-df-hj-np-tv-xz]+")
_DATE = re.compile(r"(?:19|20)[0-9]{2}(?:0[1-9]|1[0-2])")
#: Text around a string whose letter groups count as known, and how many of its own known ones make a string familiar.
FAMILIAR_REACH, FAMILIAR_SHARE = 4096, 0.5


def _odd(low: str, vowels: float = 0.34) -> bool:
    """Whether small letters have too few (or only) vowels, or too many consonants in a row, for a word."""
    share, run = sum(c in "aeiouy" for c in low) / len(low), max(map(len, _CONSONANTS.findall(low)), default=0)
    return run >= 5 or run >= 4 and share < vowels or not 0.2 <= share <= 0.8


def spoken(letters: str) -> bool:
    """Whether letters could be words, by themselves or in camel case: few changes of case, and vowels between the consonants of most of its long parts."""
    pieces = _PIECE.findall(letters)
    if len(letters) >= 8 and 2 * len(letters) < 7 * len(pieces):
        return False
    return 2 * sum(len(p) for p in pieces if len(p) >= 8 and _odd(p.lower())) < len(letters)


def _kind(run: str) -> str:
    """'word', 'letters' that are no words, or 'mixed' for a run of letters and digits (long numbers count as such) that is no name with some numbers in it."""
    if run.isdigit():
        return "mixed" if len(run) >= 16 and not _DATE.match(run) else "word"
    if run.isalpha():
        return "word" if spoken(run) else "letters"
    letters = re.findall("[A-Za-z]+", run)
    words = sum(len(p) for p in _PIECE.findall(run) if len(p) >= 3)
    return "word" if words >= 0.7 * len(run) and all(map(spoken, letters)) and not _odd("".join(letters).lower(), 0.4) else "mixed"


def plain(value: str, share: float = 0.5) -> bool:
    """Whether a string is put together of words and numbers, as paths, dates, names and identifiers are: other runs hold less than
    `share` of its letters and digits."""
    runs = [m.group() for m in _RUN.finditer(value)]
    odd = sum(len(r) for r in runs if _kind(r) != "word")
    return odd < share * max(1, sum(map(len, runs)))


def familiar(value: str, around: str, lexicon: str) -> bool:
    """Whether a string whose odd runs are letters alone is made of groups of three letters that the text around it or the lexicon has too:
    a word of whatever language is written there."""
    runs = [m.group() for m in _RUN.finditer(value)]
    if any(_kind(r) == "mixed" for r in runs):
        return False
    groups = [low[i : i + 3] for r in runs if not r.isdigit() for low in (r.lower(),) for i in range(len(low) - 2)]
    near = around.lower()
    return sum(g in near or g in lexicon for g in groups) >= FAMILIAR_SHARE * max(1, len(groups))


class Novelty:
    """Marginal compressed bytes of a string, given text around it and the identifier dictionary."""

    def __init__(self, identifiers: str = IDENTIFIERS, level: int = 3):
        import zstandard

        self._zstd, self._fixed, self._level = zstandard, identifiers.encode(), level
        self.lexicon = identifiers.lower()

    def _size(self, data: bytes, primed: bytes) -> int:
        lexicon = self._zstd.ZstdCompressionDict(primed, dict_type=self._zstd.DICT_TYPE_RAWCONTENT)
        writer = self._zstd.ZstdCompressor(level=self._level, dict_data=lexicon, write_content_size=False, write_checksum=False, write_dict_id=False)
        return len(writer.compress(data))

    def ratio(self, value: str, around: str) -> float:
        """Compressed bytes beyond an empty frame's, over the value's bytes or, if less, those that its random twin takes."""
        data, primed = value.encode(), self._fixed + around.encode()
        empty = self._size(b"", primed)
        size, whole = self._size(data, primed) - empty, max(1, len(data))
        if len(data) >= CODED and size < whole:
            whole = min(whole, max(1, self._size(twin(value).encode(), primed) - empty))
        return size / whole


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind index, end) of the fixed patterns: leftmost, non-overlapping within a kind, failing matches dropped."""
    out = [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    out += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 16]
    out += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    return sorted(out)


def sensitive(text: str) -> Iterator[tuple[int, int, int]]:
    """(start, end, from) of the lines with context: at and after `from`, a string has a context word before it.

    A word counts for the rest of its line and for the next line that isn't blank; a line that is one token passes on what it
    has (wrapped values), and all lines of a private key block have context.
    """
    carried = block = False
    for line in _LINE.finditer(text):
        start, end = line.span()
        if not text[start:end].strip():
            continue
        word = _CONTEXT.search(text, start, end)
        if carried:
            yield start, end, start
        elif word:
            yield start, end, word.end()
        # the end of a block is no context for what follows
        block = (block or _BEGIN.search(text, start, end) is not None) and _END.search(text, start, end) is None
        carried = block or word is not None and _END.search(text, start, end) is None or carried and _TOKEN.fullmatch(text[start:end].strip(_MARKS)) is not None


def candidates(start: int, end: int, known: int, value: str) -> Iterator[tuple[int, int]]:
    """(start, end) of what may be a secret in a token, the surest first: the value after a name and '=', with the name apart; the
    whole; what follows a context word in its own head. Only what has the context (from `known`) before it."""
    cut = _ASSIGNED.match(value)
    if cut and start + cut.end() >= known:
        yield start + cut.end(), end
        if start >= known:
            yield start, start + cut.end() - 1
    if start >= known:
        yield start, end
    elif known < end and (head := _HEAD_END.search(value, known - start)) and any(len(m.group()) >= 16 or _MIXED.search(m.group()) for m in _LONG.finditer(value, head.end())):
        yield start + head.end(), end


def novel_spans(text: str, taken: list[tuple[int, int, int]], novelty: Novelty, *, least: float = 0.9, around: int = 256) -> list[tuple[int, int, int]]:
    """Candidates of 16 or more token characters that have a context word before them, aren't plain words and numbers, familiar
    letters or an identifier by form, don't overlap a base span, and compress to `least` or more of what a random string of their length and alphabet takes."""
    out: list[tuple[int, int, int]] = []
    for first, last, known in sensitive(text):
        for m in _TOKEN.finditer(text, first, last):
            if m.end() <= known:
                continue
            done: list[tuple[int, int]] = []
            for start, end in candidates(*m.span(), known, m.group()):
                value = text[start:end]
                if end - start < 16 or plain(value) or _UUID.fullmatch(value) and not _SECRET_NAME.search(text, max(0, start - 32), start):
                    continue
                if familiar(value, text[max(0, start - FAMILIAR_REACH) : start] + "\n" + text[end : end + FAMILIAR_REACH], novelty.lexicon):
                    continue
                if any(a < end and start < b for a, b in done) or any(a < end and start < b for a, _, b in taken):
                    continue
                if novelty.ratio(value, text[max(0, start - around) : start] + text[end : end + around]) >= least:
                    done.append((start, end))
            out += [(a, 3, b) for a, b in done]
    return out


def find(texts: pa.Array, novelty: Novelty, least: float = 0.9) -> Iterator[tuple[int, str, list[tuple[int, int, int]]]]:
    """(row, text, sorted spans as base_spans has them) of the texts that pass a screen."""
    base = pc.match_substring_regex(texts, "|".join(_SCREEN))
    # a candidate's characters after a context word, on whatever line
    other = pc.match_substring_regex(texts, r"(?s)" + CONTEXT_WORD + r".*?[A-Za-z0-9+/_=.-]{16}")
    for i in pc.indices_nonzero(pc.or_(base, other)).to_pylist():
        value = texts[i].as_py()
        found = base_spans(value) if base[i].as_py() else []
        more = novel_spans(value, found, novelty, least=least) if other[i].as_py() else []
        yield i, value, sorted(found + more)


def scan(docs: DataFrame, *, text: str = "text", keep: tuple[str, ...] = ("doc_id",), least: float = 0.9, out_name: str = "spans") -> DataFrame:
    """keep columns and `spans` (or out_name): array of (kind, start, end), by start, then kind as listed in KINDS; code points, end exclusive.

    A null or empty text, or one without a finding, has an empty array. Every row comes back once.
    """
    span = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        novelty = Novelty()
        for batch in batches:
            texts = as_string(batch.column("_text"))
            for lo, hi in row_slices(texts, 8 << 20):
                part = texts.slice(lo, hi - lo)
                out: list[list[dict]] = [[] for _ in range(hi - lo)]
                for i, _, spans in find(part, novelty, least):
                    out[i] = [{"kind": KINDS[k], "start": a, "end": b} for a, k, b in spans]
                yield pa.RecordBatch.from_arrays([*(c.slice(lo, hi - lo) for c in batch.columns[:-1]), pa.array(out, pa.list_(span))], [*batch.schema.names[:-1], out_name])

    picked = docs.select(*keep, F.col(text).alias("_text"))
    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in picked.schema.fields[:-1])
    return picked.mapInArrow(tidied(run), fields + f"`{out_name}` array<struct<kind:string,start:bigint,end:bigint>>")


def redacted(text: str, spans: list[tuple[int, int]], mark: str) -> str:
    """text with every span (start, end) replaced by mark; overlapping ones by one mark."""
    out, at = [], 0
    for a, b in sorted(spans):
        if a >= at:
            out += [text[at:a], mark]
        at = max(at, b)
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, *, text: str = "text", mark: str = "[SECRET]", least: float = 0.9) -> DataFrame:
    """docs with every found span replaced by mark (overlapping spans by one mark), n_chars following the text where there is such a column.

    Every row comes back once, with all its columns; nulls, empty texts and texts without a finding as they are. Texts go to
    Python once, and only changed ones come back.
    """

    @F.arrow_udf("string")
    def changed(texts: pa.Array) -> pa.Array:
        novelty, out = Novelty(), []
        whole = as_string(texts)
        for lo, hi in row_slices(whole, 8 << 20):
            part = whole.slice(lo, hi - lo)
            own = [None] * (hi - lo)
            for i, value, spans in find(part, novelty, least):
                if spans:
                    own[i] = redacted(value, [(a, b) for a, _, b in spans], mark)
            out += own
        release()
        return pa.array(out, pa.string())

    (fresh,) = unused(docs.columns, "changed")
    found = docs.withColumn(fresh, changed(F.col(text)))
    values = {text: F.coalesce(F.col(fresh), F.col(text))}
    if "n_chars" in docs.columns:
        values["n_chars"] = F.length(values[text]).cast(docs.schema["n_chars"].dataType)
    return found.select(*(values[c].alias(c) if c in values else F.col(f"`{c}`") for c in docs.columns))


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's counts and digest of the base spans, and all its spans (see scan)."""
    found = scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = "filter(spans, s -> s.kind <> 'novel')"

    def joined(spans: str) -> str:
        return f"array_join(transform({spans}, s -> concat_ws(':', s.kind, s.start, s.end)), ',')"

    def n(kind: str):
        return F.expr(f"cast(size(filter(spans, s -> s.kind = '{kind}')) as bigint)")

    return found.select(
        "doc_id", n("assign").alias("n_assign"), n("access").alias("n_access"), n("hex").alias("n_hex"), F.sha2(F.expr(joined(base)).cast("binary"), 256).alias("base_sha256"), F.expr(joined("spans")).alias("spans")
    )
