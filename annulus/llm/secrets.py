"""Operator 8: secret scan with dictionary-primed zstandard novelty.

Base kinds are fixed patterns (assign, access, hex).  The method adds kind
``novel``: long tokens whose surroundings name something sensitive, kept if
zstandard, primed with a dictionary of code and identifiers and with the text
around the token, still needs many bytes for it.  The marginal size is
compressed(context + token) - compressed(context).

Defined cases: a null text is empty; bytes that aren't UTF-8 count as one U+FFFD
each in the scan, and texts without findings pass `redact` as they are; documents without findings keep a row with
empty spans (base_sha256 of nothing); offsets are code points; repeated rows
are scanned each; null ids are kept; further columns are ignored; an empty table
gives no rows.  Texts of any length are scanned whole.
"""

from __future__ import annotations

import bisect
import hashlib
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

KINDS = ("assign", "access", "hex", "novel")
ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")  # runs are maximal, so this is [0-9a-f]+ with 32 or more
TOKEN = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
SENSITIVE = re.compile(r"(?i)pass|secret|token|key|auth|cred|bearer|private|signature|session|cert|pwd|login")
#: RE2 prefilters that can't miss a finding; ſ and K fold to s and k in Python without re.ASCII, which is set
MAY_BASE = r"(?i:password|passwd|secret|token|api_?key)|AKIA[A-Z0-9]|[0-9a-f]{32}"
MAY_NOVEL = r"[A-Za-z0-9+/_=-]{20}"

_WORDS = """password passwd secret token api_key apikey access_key private_key public_key client_id client_secret auth authorization bearer
basic credential credentials session cookie login user username account email host hostname port server database connection string url http https
localhost config settings environment export import from return class function def self this public static void const let var new null None true
false True False int str float bool char byte long string list dict map set array object value name type index count size length key item data
result response request error exception try catch except finally raise throw print log logger debug info warning open read write close file path
begin end if else for while switch case break continue BEGIN RSA PRIVATE KEY END CERTIFICATE ssh-rsa AWS_SECRET_ACCESS_KEY AWS_ACCESS_KEY_ID
GITHUB_TOKEN SLACK_TOKEN abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ 0123456789 example sample test placeholder changeme xxxxxxxx
that this with have from they will would there their what about which when make like time just know people into year your good some could them
und der die das nicht ist mit sich auf ein eine les des une dans pour pas que qui sur est los las una por para con como pero"""
DICTIONARY = (_WORDS + " " + " ".join(f'{a}_{b} = "{a}"; {b}={a};' for a in ("user", "api", "client", "access", "auth") for b in ("key", "token", "id", "secret", "name"))).encode()


class Novelty:
    """Marginal compressed bytes of a token after the primed dictionary and its context."""

    def __init__(self, dictionary: bytes = DICTIONARY):
        primed = zstandard.ZstdCompressionDict(dictionary, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        self.c = zstandard.ZstdCompressor(level=9, dict_data=primed, write_content_size=False, write_checksum=False, write_dict_id=False)

    def marginal(self, context: bytes, token: bytes) -> int:
        return len(self.c.compress(context + token)) - len(self.c.compress(context))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind index, end) of the base kinds, in order."""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def novel_spans(text: str, base: list[tuple[int, int, int]], novelty: Novelty, around: int = 64, least: float = 0.6) -> list[tuple[int, int, int]]:
    """Tokens outside base spans, in a sensitive context, that take at least `least` bytes a character."""
    out = []
    # the base spans' union, as sorted disjoint ranges
    starts: list[int] = []
    ends: list[int] = []
    for a, _, b in base:
        if ends and a <= ends[-1]:
            ends[-1] = max(ends[-1], b)
        else:
            starts.append(a)
            ends.append(b)
    for m in TOKEN.finditer(text):
        s, e = m.span()
        k = bisect.bisect_left(starts, e)  # ranges before k start before the token's end
        if k and ends[k - 1] > s:
            continue
        before, after = text[max(0, s - around) : s], text[e : e + around // 2]
        if not SENSITIVE.search(before) and not SENSITIVE.search(after):
            continue
        token = m.group()
        if len({c.isdigit() for c in token} | {2 if c.isupper() else 3 for c in token if c.isalpha()}) < 3:
            continue  # a letters-only or single-case word
        if novelty.marginal((before + after).encode(), token.encode()) >= least * len(token):
            out.append((s, 3, e))
    return out


def digest(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def readable(text: pa.Array) -> pa.Array:
    """The texts, null as empty and bytes that aren't UTF-8 as U+FFFD."""
    text = pc.fill_null(text, "")
    try:
        text.validate(full=True)
        return text
    except pa.ArrowInvalid:
        return pa.array([x.decode("utf-8", "replace") for x in text.cast(pa.binary()).to_pylist()], pa.string())


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", dictionary: bytes = DICTIONARY) -> DataFrame:
    """One row per document: doc_id, n_assign, n_access, n_hex, n_novel, base_sha256, spans."""
    none = hashlib.sha256(b"").hexdigest()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        novelty = Novelty(dictionary)
        for batch in batches:
            text = readable(batch.column(1))
            may = pc.or_(pc.match_substring_regex(text, MAY_BASE), pc.match_substring_regex(text, MAY_NOVEL))
            n = batch.num_rows
            count = [[0] * n for _ in KINDS]
            sha, spans = [none] * n, [""] * n
            for i in pc.indices_nonzero(may).to_pylist():
                t = text[i].as_py()
                base = base_spans(t)
                every = sorted(base + novel_spans(t, base, novelty))
                for _, k, _ in every:
                    count[k][i] += 1
                sha[i], spans[i] = hashlib.sha256(digest(base).encode()).hexdigest(), digest(every)
            yield pa.record_batch([batch.column(0), *[pa.array(c, pa.int64()) for c in count], pa.array(sha, pa.string()), pa.array(spans, pa.string())], names=["doc_id", "n_assign", "n_access", "n_hex", "n_novel", "base_sha256", "spans"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, n_assign long, n_access long, n_hex long, n_novel long, base_sha256 string, spans string")


def redact(docs: DataFrame, mask: str = "[SECRET]", text_col: str = "text", dictionary: bytes = DICTIONARY) -> DataFrame:
    """The same rows with every finding replaced by mask (overlapping findings by one); null texts stay null. A column n_chars, if there, follows the text."""
    names, at = docs.columns, docs.columns.index(text_col)
    counted = names.index("n_chars") if "n_chars" in names else None

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        novelty = Novelty(dictionary)
        for batch in batches:
            text = batch.column(at)
            full = readable(text)
            may = pc.or_(pc.match_substring_regex(full, MAY_BASE), pc.match_substring_regex(full, MAY_NOVEL))
            new = {}
            for i in pc.indices_nonzero(may).to_pylist():
                t = full[i].as_py()
                base = base_spans(t)
                out, end = [], 0
                for s, _, e in sorted(base + novel_spans(t, base, novelty)):
                    if s >= end:
                        out += [t[end:s], mask]
                    end = max(end, e)
                if out:
                    new[i] = "".join(out) + t[end:]
            columns = list(batch.columns)
            if new:
                values = text.cast(pa.binary()).to_pylist()
                for i, t in new.items():
                    values[i] = t.encode()
                columns[at] = pa.array(values, pa.binary()).view(pa.string())
                if counted is not None:
                    n = columns[counted].to_pylist()
                    for i, t in new.items():
                        n[i] = len(t)
                    columns[counted] = pa.array(n, columns[counted].type)
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return docs.mapInArrow(run, docs.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_secrets(spark.read.parquet(f"{sf_dir}/documents.parquet"))
