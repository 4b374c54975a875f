"""Secret scans: fixed patterns, and a linear-chain conditional random field over tokens."""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, blocks, prepare, word_spans

ASSIGN = re.compile(r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
KINDS = ("assign", "access", "hex", "crf")
WORDS_OF_ASSIGN = (b"passw", b"secret", b"token", b"apikey", b"api_key")

#: A token is a run of these bytes, or any other visible character by itself.
IN_TOKEN = np.zeros(256, bool)
IN_TOKEN[[*range(48, 58), *range(65, 91), *range(97, 123), *b"+/_-"]] = True
TOKEN = re.compile(r"[A-Za-z0-9+/_-]+|[^\sA-Za-z0-9+/_-]")
#: Characters around a token first looked at for the bounds of its stretch; twice as many until they are found.
REACH = 256
BUCKETS = 1 << 13
B, I, O = 0, 1, 2
CREDENTIAL = {"password", "passwd", "passphrase", "pwd", "pass", "secret", "token", "apikey", "api_key", "key", "auth", "authorization", "bearer", "credential", "credentials", "client_secret", "access_key", "secret_key", "private_key", "aws_secret_access_key", "login", "pin"}
HARMLESS = {"version", "id", "order", "commit", "sha", "sha1", "sha256", "md5", "checksum", "build", "isbn", "sku", "uuid", "color", "date", "file", "url", "model", "part", "room", "ref", "invoice", "ticket", "issue", "size", "port", "etag", "revision"}


#: Parts of words that one of CREDENTIAL is made of: a text without them has no place that OPENS.
ROOTS = (b"pass", b"pwd", b"secret", b"token", b"key", b"auth", b"bearer", b"credential", b"login", b"pin")
#: What stands before a value: a name with a credential's word in it and a sign or "is", or the scheme of a header.
OPENS = re.compile(
    rf"(?ai)(?<![a-z0-9])(?:[a-z0-9]{{1,40}}[_-]){{0,4}}(?:{'|'.join(sorted(CREDENTIAL, key=len, reverse=True))})(?:[_-][a-z0-9]{{1,20}}){{0,2}}"
    r"""["'\]]{0,2}[ \t]{0,4}(?::=|=>|->|[:=]|is\b)[ \t]{0,4}(?:bearer[ \t]{1,4}|basic[ \t]{1,4})?["'`]?(?=\S)|(?<![a-z0-9])bearer[ \t]{1,4}(?=\S)"""
)


def may_be_secret(token: str) -> bool:
    """Whether a token can begin a secret by its shape, wherever it stands."""
    n, digits = len(token), sum(c.isdigit() for c in token)
    letters = sum(c.isalpha() for c in token)
    upper = sum(c.isupper() for c in token)
    return n >= 8 and digits >= 1 and letters >= 1 or n >= 20 and upper >= 2 and letters - upper >= 2


def openings(text: str) -> list[int]:
    """Where a value begins behind a credential's word: what stands there can begin a secret whatever its shape."""
    return [m.end() for m in OPENS.finditer(text)]


def shape(token: str) -> str:
    out = []
    for c in token:
        k = "9" if c.isdigit() else "A" if c.isupper() else "a" if c.isalpha() else c
        if not out or out[-1] != k:
            out.append(k)
    return "".join(out[:6]) + ("~" if len(out) > 6 else "")


def entropy(token: str) -> float:
    n = len(token)
    return -sum(v / n * math.log2(v / n) for v in Counter(token).values())


def charset(token: str) -> str:
    for name, pattern in (("hex", r"[0-9a-f]+"), ("HEX", r"[0-9A-F]+"), ("lower9", r"[0-9a-z]+"), ("UPPER9", r"[0-9A-Z]+"), ("alnum", r"[0-9A-Za-z]+"), ("slug", r"[0-9a-z_-]+"), ("path", r"[0-9A-Za-z_-]*(/[0-9A-Za-z_-]+)+")):
        if re.fullmatch(pattern, token):
            return name
    return "mixed"


def features(tokens: list[str], gaps: list[bool], i: int, file: tuple[str, ...]) -> list[str]:
    """Shape, neighbouring words and file features of token i. gaps[i]: white space stands before it."""
    t = tokens[i]
    near = [x.lower() for x in tokens[max(0, i - 5) : i] if x[0].isalnum()]
    before = tokens[i - 1].lower() if i else "<s>"
    words = {w for x in near for w in (x, *re.split(r"[_-]", x))}
    known = str(bool(words & CREDENTIAL))
    out = ["1", "so:" + shape(t) + known + str(gaps[i]), "s:" + shape(t), "n:" + str(min(12, len(t) // 4)), "p:" + before[:12], "p2:" + (tokens[i - 2].lower()[:12] if i > 1 else "<s>"), "x:" + (tokens[i + 1].lower()[:12] if i + 1 < len(tokens) else "</s>"), "g:" + str(gaps[i])]
    out += ["k:" + str(bool(words & CREDENTIAL)), "h:" + str(bool(words & HARMLESS))]
    if len(t) > 1:
        c = charset(t)
        digits = sum(x.isdigit() for x in t)
        e = int(entropy(t) * 2)
        out += ["c:" + c, "e:" + str(e), "d:" + str(digits * 5 // len(t)), "q:" + t[:4].lower(), "cn:" + c + str(min(12, len(t) // 4)), "ce:" + c + str(e), "ck:" + c + str(bool(words & CREDENTIAL)), "ek:" + str(e) + str(bool(words & CREDENTIAL)), "eh:" + str(e) + str(bool(words & HARMLESS))]
        out += ["fk:" + x + str(bool(words & CREDENTIAL)) for x in file]
    return out + ["f:" + x for x in file]


def bucket(feature: str) -> int:
    return zlib.crc32(feature.encode("utf-8", "surrogatepass")) % BUCKETS


def file_features(text: str, extension: str | None = None) -> tuple[str, ...]:
    """What the whole text looks like: the share of lines that set a name to a value, of symbols, and a file's extension."""
    lines = text.count("\n") + 1
    sets = len(re.findall(r"(?m)^\s*[\w.-]+\s*[:=]", text)) / lines
    symbols = sum(text.count(c) for c in "{}();=<>") / max(1, len(text))
    out = ("sets:" + str(min(3, int(sets * 4))), "code:" + str(symbols > 0.02))
    return (*out, "ext:" + extension.lower()) if extension else out


class Chain:
    """Scores of the states by feature, and of the transitions; I follows B or I only."""

    def __init__(self, emit: np.ndarray, move: np.ndarray):
        self.emit, self.move = emit, move

    def decode(self, rows: list[list[int]], allowed: np.ndarray) -> list[int]:
        """Viterbi: the best states of one sequence. allowed: (n, 3), states a token may have."""
        n = len(rows)
        score = np.array([self.emit[r].sum(0) for r in rows])
        score[~allowed] = -np.inf
        best, back = score[0].copy(), np.zeros((n, 3), int)
        best[I] = -np.inf
        for t in range(1, n):
            step = best[:, None] + self.move
            back[t] = step.argmax(0)
            best = step.max(0) + score[t]
        out = [int(best.argmax())]
        for t in range(n - 1, 0, -1):
            out.append(int(back[t, out[-1]]))
        return out[::-1]


def permitted(tokens: list[str], gaps: list[bool], opened: list[bool]) -> np.ndarray:
    """States a token may have: begin where it may be secret by its shape or its place (opened); inside in the rest of
    the same run, up to white space. All else is outside by constraint."""
    out = np.zeros((len(tokens), 3), bool)
    run = False
    for i, t in enumerate(tokens):
        begins = opened[i] or may_be_secret(t)
        out[i] = begins, run and not gaps[i], True
        run = begins or run and not gaps[i]
    return out


def train(sequences: list[tuple[list[list[int]], list[int], np.ndarray]], rounds: int = 90, l2: float = 2e-4) -> Chain:
    """Maximum conditional likelihood by Adam; forward-backward runs over all sequences at once."""
    n, longest = len(sequences), max(len(s[1]) for s in sequences)
    wide = max(len(r) for s in sequences for r in s[0])
    index = np.full((n, longest, wide), BUCKETS)
    state, live, open_ = np.full((n, longest), O), np.zeros((n, longest), bool), np.zeros((n, longest, 3), bool)
    for k, (rows, labels, allowed) in enumerate(sequences):
        for t, r in enumerate(rows):
            index[k, t, : len(r)] = r
        state[k, : len(labels)], live[k, : len(labels)], open_[k, : len(labels)] = labels, True, allowed
    open_[~live] = [False, False, True]
    wall = np.array([[0, 0, 0], [0, 0, 0], [0, -1e9, 0]], float)
    emit, move = np.zeros((BUCKETS + 1, 3)), np.zeros((3, 3))
    gold = np.zeros((n, longest, 3))
    np.put_along_axis(gold, state[..., None], 1, 2)
    gold_move = np.einsum("nti,ntj->ij", gold[:, :-1] * live[:, 1:, None], gold[:, 1:])
    memory = [(np.zeros_like(p), np.zeros_like(p)) for p in (emit, move)]
    for step in range(1, rounds + 1):
        score = np.where(open_, emit[index].sum(2), -1e9) * 1.0
        score[~live] = [-1e9, -1e9, 0]
        trans = move + wall
        forward, backward = np.zeros((n, longest, 3)), np.zeros((n, longest, 3))
        forward[:, 0] = score[:, 0] + np.array([0, -1e9, 0])
        for t in range(1, longest):
            x = forward[:, t - 1, :, None] + trans
            top = x.max(1)
            forward[:, t] = top + np.log(np.exp(x - top[:, None]).sum(1)) + score[:, t]
        for t in range(longest - 2, -1, -1):
            x = trans + (score[:, t + 1] + backward[:, t + 1])[:, None, :]
            top = x.max(2)
            backward[:, t] = top + np.log(np.exp(x - top[..., None]).sum(2))
        top = forward[:, -1].max(1)
        z = top + np.log(np.exp(forward[:, -1] - top[:, None]).sum(1))
        belief = np.exp(forward + backward - z[:, None, None])
        pair = np.exp(forward[:, :-1, :, None] + trans + (score + backward)[:, 1:, None, :] - z[:, None, None, None]) * live[:, 1:, None, None]
        g = ((belief - gold) * live[..., None]).reshape(-1, 3) / n
        grad = np.zeros_like(emit)
        for s in range(3):
            grad[:, s] = np.bincount(index.reshape(-1), np.repeat(g[:, s], wide), BUCKETS + 1)
        grad[BUCKETS] = 0
        for p, d, (m, v) in zip((emit, move), (grad + l2 * emit, (pair.sum((0, 1)) - gold_move) / n + l2 * move), memory):
            m += 0.1 * (d - m)
            v += 0.01 * (d**2 - v)
            p -= 0.08 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return Chain(emit[:BUCKETS], move + wall)


def made_file(rng: np.random.Generator, kind: str, lines: int = 8) -> tuple[list[tuple[str, str]], str]:
    """((line, the secret in it or ''), ...) and the extension of a made-up file: settings, code or prose.

    In settings a credential's value is mostly a secret, in prose mostly a word about it, in code either.
    """
    pick = lambda x: x[int(rng.integers(len(x)))]
    run = lambda chars, a, b: "".join(pick(chars) for _ in range(int(rng.integers(a, b + 1))))
    lower, upper, digits = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
    syllables = [a + b for a in "bdfghklmnprstvw" for b in "aeiou"]
    word = lambda a=1, b=4: "".join(pick(syllables) for _ in range(int(rng.integers(a, b + 1)))) + pick(["", "", "n", "r", "s", "t"])
    values = [
        lambda: run(digits + "abcdef", 16, 64),
        lambda: run(lower + upper + digits, 12, 40),
        lambda: run(lower + upper + digits + "+/", 24, 60) + pick(["", "=", "=="]),
        lambda: run(upper, 3, 4) + run(upper + digits, 14, 20),
        lambda: pick(["ghp_", "sk_live_", "xoxb-", "glpat-", "pk_", "AIza"]) + run(lower + upper + digits, 16, 36),
        lambda: pick([word().title(), word()]) + run(digits, 1, 4) + pick(["", "x" + run(digits, 2, 3)]),
        lambda: "eyJ" + run(lower + upper + digits, 12, 24) + "." + run(lower + upper + digits, 12, 30) + "." + run(lower + upper + digits + "_-", 20, 40),
        lambda: word().title().replace("a", "@").replace("o", "0") + pick("!?#$%&*") + run(digits, 1, 4),
        lambda: run(lower + upper + digits + "!@#$%^&*", 8, 18),
        lambda: "-".join(word(2, 3) for _ in range(int(rng.integers(3, 6)))),
        lambda: run(lower, 18, 32),
        lambda: run(digits, 4, 8),
    ]
    plain = [lambda: run(digits + "abcdef", 7, 40), lambda: run(digits, 3, 16), lambda: word() + run(digits, 1, 4) + word(), lambda: word() + "_" + run(digits, 6, 8) + "_" + run(digits, 4, 6), lambda: "-".join(run(digits + "abcdef", k, k) for k in (8, 4, 4, 4, 12)), lambda: "20" + run(digits, 2, 2) + "-0" + run("123456789", 1, 1) + "-1" + run(digits, 1, 1), lambda: "/".join([word(), word() + run(digits, 1, 3), word()]), lambda: upper[int(rng.integers(26))] + run(digits, 3, 4) + "-" + run(upper + digits, 4, 6), word, lambda: word() + "." + word()]
    about = [word, lambda: word().title(), lambda: word(1, 2) + " " + word(1, 2), lambda: word() + "." + word() + "()", lambda: word() + "(" + word() + ")", lambda: "<" + word() + "-" + word() + ">", lambda: "${" + word().upper() + "}", lambda: pick(["str", "string", "None", "null", "true", "required", "optional", "changeme", "hidden"]), lambda: word() + "," + word(), lambda: "****"]
    share = {"settings": 0.9, "code": 0.55, "prose": 0.35}[kind]
    out = []
    for _ in range(lines):
        quote = pick({"settings": ["", "", "", '"'], "code": ['"', "'", '"', ""], "prose": ["", "", "", '"']}[kind])
        sep = pick({"settings": ["=", ": ", ":", " = "], "code": [" = ", "=", ": ", " := "], "prose": [" is ", ": ", " is ", ":"]}[kind])
        head = "" if kind == "settings" else pick(["", "    ", word() + "."]) if kind == "code" else " ".join(word() for _ in range(int(rng.integers(0, 6)))) + " "
        tail = {"settings": "", "code": pick([";", "", "  # " + word()]), "prose": " " + " ".join(word() for _ in range(int(rng.integers(0, 6))))}[kind]
        if rng.random() < 0.55:
            name = pick(sorted(CREDENTIAL))
            name = pick([name, name.upper(), name.title(), word() + "_" + name, name + "_" + word(1, 1)])
            secret = pick(values)() if rng.random() < share else ""
            if name.lower() in ("bearer", "authorization") and rng.random() < 0.7:
                name, sep = pick(["Authorization: Bearer", "bearer"]), " "
            value = secret or pick(about)()
            line = f"{head}{name}{sep}{quote}{value}{quote}{tail}"
        elif rng.random() < 0.12:
            secret = pick(values[:5])()  # alone, to be known by its shape only
            line = f"{head}{secret}{tail}"
        else:
            secret, value = "", pick(plain)()
            line = f"{head}{pick([*sorted(HARMLESS), word(), word()])}{pick([sep, ' '])}{quote}{value}{quote}{tail}"
        out.append((line.rstrip(), secret))
    return out, pick({"settings": ["env", "ini", "yaml", "properties"], "code": ["py", "js", "go", "java"], "prose": ["md", "txt", "log"]}[kind])


def example(rng: np.random.Generator) -> tuple[str, str]:
    """(line, the secret in it or '') of made-up material."""
    return made_file(rng, ("settings", "code", "prose")[int(rng.integers(3))], 1)[0][0]


def read_tokens(text: str, low: int = 0, high: int | None = None, opens: frozenset[int] = frozenset()) -> tuple[list, list[str], list[bool], np.ndarray]:
    """(matches, tokens, whether white space stands before each, states each may have) of a part of a text."""
    found = list(TOKEN.finditer(text, low, len(text) if high is None else high))
    tokens = [m[0] for m in found]
    gaps = [m.start() == 0 or text[m.start() - 1].isspace() for m in found]
    return found, tokens, gaps, permitted(tokens, gaps, [m.start() in opens for m in found])


@lru_cache(2)
def fitted(files: int = 240, seed: int = 7) -> Chain:
    """The field, trained on the lines of made-up files with the features of the whole file; the same for the same arguments."""
    rng = np.random.default_rng(seed)
    made = []
    for k in range(files):
        lines, extension = made_file(rng, ("settings", "code", "prose")[k % 3])
        file = file_features("\n".join(x for x, _ in lines), extension if rng.random() < 0.5 else None)
        for line, secret in lines:
            found, tokens, gaps, allowed = read_tokens(line, opens=frozenset(openings(line)))
            found, tokens, gaps, allowed = found[:32], tokens[:32], gaps[:32], allowed[:32]
            at = line.rfind(secret) if secret else -1
            labels, inside = [], False
            for i, m in enumerate(found):
                own = secret and at <= m.start() < at + len(secret)
                label = O if not own else I if inside and allowed[i, I] else B if not inside and allowed[i, B] else O
                inside = label != O
                labels.append(label)
            if tokens:
                made.append(([[bucket(f) for f in features(tokens, gaps, i, file)] for i in range(len(tokens))], labels, allowed))
    return train(made)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the fixed patterns: leftmost, non-overlapping within a kind; failing matches are dropped."""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    return sorted(out + [(m.start(), 2, m.end()) for m in HEX.finditer(text) if m.end() - m.start() >= 32])


def field_spans(text: str, chain: Chain, extension: str | None = None, hot: list[int] | None = None) -> list[tuple[int, int]]:
    """(start, end) of the secrets that the field tags. hot: where tokens stand that may be secret by their shape, if known.

    A token that is outside by constraint separates what stands on its sides, so the best states of the whole text are
    those of the stretches between such tokens. A stretch is looked for as far as it goes, and its features see the
    five tokens before it and the one behind it.
    """
    opens = frozenset(openings(text))
    if hot is None:
        hot = [m.start() for m in TOKEN.finditer(text) if may_be_secret(m[0])]
    out, file, done = [], file_features(text, extension), 0
    for s in sorted({*hot, *opens}):
        if s < done:
            continue
        reach = REACH
        while True:
            low, high = max(0, s - reach), min(len(text), s + reach)
            while low > 0 and in_token(text[low - 1]) and in_token(text[low]):
                low -= 1
            while high < len(text) and in_token(text[high - 1]) and in_token(text[high]):
                high += 1
            found, tokens, gaps, allowed = read_tokens(text, low, high, opens)
            free = allowed[:, B] | allowed[:, I]
            at = next((k for k, m in enumerate(found) if m.start() >= s), len(found))
            first = at
            while first > 0 and free[first - 1]:
                first -= 1
            last = at
            while last < len(found) and free[last]:
                last += 1
            if (low == 0 or first >= 6) and (high == len(text) or last + 1 < len(found)):
                break
            reach *= 2
        first, last = max(0, first - 1), min(len(found), last + 1)  # with the tokens outside on either side
        if first < last:
            states = chain.decode([[bucket(f) for f in features(tokens, gaps, i, file)] for i in range(first, last)], allowed[first:last])
            begin = stop = None
            for m, state in [*zip(found[first:last], states), (None, O)]:
                if state != I and begin is not None:
                    out.append((begin, stop))
                    begin = None
                if state == B:
                    begin = m.start()
                if state != O:
                    stop = m.end()
            done = found[last - 1].end()
    return out


def in_token(c: str) -> bool:
    return c.isascii() and bool(IN_TOKEN[ord(c)])


def scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", extension_col: str | None = None) -> DataFrame:
    """id and spans (array of kind, start, end; code points, ends exclusive) of the secrets in every whole text.

    Kinds assign, access and hex are fixed patterns; kind crf is what the field tags besides, where it overlaps
    none of theirs. The field's states are begin, inside and outside. A secret can begin at a token of a secret's shape,
    anywhere, and at any token behind a credential's word; texts without either do not reach the field.

    Null and empty texts have no spans; texts of any length are read whole, and a secret may be as long as its text; of
    overlapping spans of one kind the leftmost counts; repeated rows each get theirs; an empty table gives none; other
    columns are ignored, whatever their names.
    """
    sent = prepare(df.sparkSession).sparkContext.broadcast(fitted())
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chain = sent.value
        for block in blocks(batches):
            data, at = as_bytes(block.column(1))
            starts, ends, row = word_spans(data, at, ~IN_TOKEN)
            counts = [np.concatenate(([0], np.cumsum(m, dtype=np.int32))) for m in ((data >= 48) & (data <= 57), (data >= 65) & (data <= 90), (data >= 97) & (data <= 122))]
            digits, upper, lower = (c[ends] - c[starts] for c in counts)
            n = ends - starts
            hot = (n >= 8) & (digits >= 1) & (upper + lower >= 1) | (n >= 20) & (upper >= 2) & (lower >= 2)
            long = np.zeros(block.num_rows, bool)
            long[row[(n >= 32) & (digits + lower >= 32)]] = True
            by_row: dict[int, list[int]] = {}
            for k in np.flatnonzero(hot):
                by_row.setdefault(int(row[k]), []).append(int(starts[k]))
            raw, spans = data.tobytes(), []
            extensions = block.column(2).to_pylist() if extension_col else None
            for k, (s, e) in enumerate(zip(at[:-1].tolist(), at[1:].tolist())):
                own, base, more = raw[s:e], [], []
                signs = b"=" in own or b":" in own
                low = own.lower()
                named = signs and any(w in low for w in WORDS_OF_ASSIGN)
                opened = any(w in low for w in ROOTS)
                if named or long[k] or b"AKIA" in own or k in by_row or opened:
                    text = own.decode("utf-8", "replace")
                    if named or long[k] or b"AKIA" in own:
                        base = base_spans(text)
                    if k in by_row or opened and OPENS.search(text):
                        tokens = [b - s for b in by_row.get(k, ())]
                        if tokens and len(text) != len(own):
                            points = np.cumsum((data[s:e] & 0xC0) != 0x80)
                            tokens = (points[tokens] - 1).tolist()
                        more = [(a, 3, b) for a, b in field_spans(text, chain, extensions[k] if extensions else None, tokens) if not any(a < y and x < b for x, _, y in base)]
                spans.append([{"kind": KINDS[c], "start": a, "end": b} for a, c, b in sorted(base + more)])
            kinds = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays([block.column(0), pa.array(spans, kinds)], names=["id", "spans"])

    own = [F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")]
    own += [F.col(extension_col).cast("string").alias("extension")] if extension_col else []
    out = df.select(*own).mapInArrow(run, f"id {kind}, spans array<struct<kind: string, start: long, end: long>>")
    return out.select(F.col("id").alias(id_col), "spans")
