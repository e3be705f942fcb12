"""Personal data: exact patterns, plus a character BiLSTM with a CRF.

Patterns find emails, IP addresses, card and phone numbers.  A character-level
bidirectional LSTM with CRF transitions is trained in numpy on a bounded sample of
windows: on spans that the patterns label, and on the same spans rewritten into forms
that the patterns miss (``altered``: letters beyond ASCII in addresses, other separators,
phone prefixes dropped or bracketed), in the text around them.  Failed candidates are its
negatives, unless they are such a form themselves.  It reads every region around a digit
or an ``@`` of every text; all four kinds hold one of these.  A region is cut into overlapping windows,
the windows' emissions are blended by distance from the window's edge, and one
CRF pass decodes the whole region, so no span depends on where a window ends.
Regions have no greatest length: a long one is decoded alone, in blocks that hand
on their boundary scores, which gives what one pass gives.
A decoded span is added when its posterior is at least the model's confidence at each
character (the least of ``CONFIDENCES`` at which ``PRECISION`` of such spans are right
on every fifth window, which the fit that sets it leaves out; none reaches it: nothing is
added), it has the digits, checksum or parts of its kind, and it touches no
pattern span.  Pattern spans always stay.

The only bounded part is the training sample: ``TRAIN_REGIONS`` windows of all
regions of all documents, half with a labelled character, a fifth with a rewritten span, the rest without (more
of the one where there are few of the other), those with the smallest hashes of
id, place and content.

Defined cases: a null or empty text has no span; without any labelled span the
patterns decide alone; repeated rows are read each; an empty table gives an
empty result.  Offsets are code points, the end is exclusive.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetlens.llm.common import kept, map_texts

# ---- fixed values: kinds and patterns ----
KINDS = ("email", "ip", "card", "phone")
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# ---- end of fixed values ----
#: what follows an address's ``@``
DOMAIN = re.compile(EMAIL.pattern.split("@")[1])
#: a match can start at the first digit of a run only: where that fails, the run's other digits fail too
IP_START = re.compile("(?<![0-9])" + IP.pattern)
TRIGGER = re.compile("[0-9@]+")
MARGIN, WINDOW, STRIDE = 24, 64, 32
TRAIN_REGIONS = 1500
#: posteriors to choose from, and the share of right spans that the chosen one needs
CONFIDENCES, PRECISION = (0.8, 0.9, 0.95, 0.98, 0.99), 0.95
#: characters that are decoded at once: of a group's windows, of a padded batch, of a long region's block
GROUP_CHARS, BATCH_CHARS, BLOCK = 1 << 16, 1 << 15, 1 << 13
HIDDEN, CHARS = 16, 130
TAGS = 1 + 2 * len(KINDS)  # O, then B and I of each kind

#: emissions after a region's end: O
END = np.array([0.0] + [-1e4] * (TAGS - 1))[None, None]

#: forms that the patterns miss: put into addresses, between the parts of IP addresses and of card numbers
WIDE, IP_FORMS, CARD_FORMS = "éüñøßçåё", ("[.]", " . ", "(.)"), (".", "/", "  ", "\u00a0")
#: such forms as they stand in texts, by kind
HIDDEN_FORMS = tuple(map(re.compile, (
    r"[\w.%+-]{1,64}@[\w-]{1,64}\.[\w.-]{1,64}", r"[0-9]{1,3}(?:[^0-9A-Za-z]{1,3}[0-9]{1,3}){3}",
    r"[0-9]{4}(?:[^0-9A-Za-z]{1,2}[0-9]{1,4}){2,4}", r"(?:\(|\b00\x20?)[0-9][\x20().0-9-]{6,24}[0-9]")))

Span = tuple[int, int, int]  # kind, start, end


def luhn(digits: str) -> bool:
    d = [int(c) for c in reversed(digits)]
    return sum(d[0::2] + [x * 2 - 9 * (x > 4) for x in d[1::2]]) % 10 == 0


def valid(kind: int, s: str) -> bool:
    digits = re.sub("[^0-9]", "", s)
    if kind == 1:
        parts = re.findall("[0-9]+", s)
        return len(parts) == 4 and all(len(p) < 20 and int(p) <= 255 for p in (x.lstrip("0") or "0" for x in parts))
    if kind == 2:
        return 13 <= len(digits) <= 19 and luhn(digits)
    if kind == 3:
        return 9 <= len(digits) <= 15
    return bool(re.fullmatch(r"[^@\s]+@[^@\s]+\.[^@\s]+", s))


def emails(text: str) -> list[Span]:
    """The pattern's matches, looked for from each ``@``: the local part reaches back to the
    first character after the match before, the ``@`` before or any other character, so each
    character is passed once however long its run is."""
    out, end, at = [], 0, text.find("@")
    while at >= 0:
        a = at
        while a > end and text[a - 1] in LOCAL_CHARS:
            a -= 1
        domain = DOMAIN.match(text, at + 1) if a < at else None
        if domain:
            out.append((0, a, domain.end()))
            end = domain.end()
        at = text.find("@", max(at + 1, end))
    return out


def base_spans(text: str) -> list[Span]:
    """Pattern spans by kind, then start."""
    out = emails(text)
    for kind, pattern in ((1, IP_START), (2, CARD), (3, PHONE)):
        out += [(kind, m.start(), m.end()) for m in pattern.finditer(text) if valid(kind, m.group())]
    return out


def regions(text: str) -> list[tuple[int, int]]:
    """Merged surroundings of digits and ``@``."""
    out: list[list[int]] = []
    for m in TRIGGER.finditer(text):
        a, b = max(0, m.start() - MARGIN), min(len(text), m.end() + MARGIN)
        if out and a <= out[-1][1]:
            out[-1][1] = b
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def coded(s: str) -> np.ndarray:
    """ASCII as it is, other letters 127, other characters 128, padding 129."""
    c = np.frombuffer(s.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    wide = np.flatnonzero(c > 126)
    c[wide] = [127 if s[i].isalpha() else 128 for i in wide]
    return c.astype(np.uint8)


def windows(regions_: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Overlapping windows of all regions: characters, region, offset."""
    x, region, offset = [], [], []
    for i, c in enumerate(regions_):
        for a in range(0, max(len(c) - WINDOW, 0) + STRIDE, STRIDE):
            w = np.full(WINDOW, CHARS - 1, np.int64)
            part = c[a:a + WINDOW]
            if len(part):
                w[:len(part)] = part
                x.append(w)
                region.append(i)
                offset.append(a)
    return np.array(x).reshape(-1, WINDOW), np.array(region), np.array(offset)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def new_model(seed: int = 11) -> dict[str, np.ndarray]:
    r, h = np.random.default_rng(seed), HIDDEN
    m = {f"{k}{d}": r.normal(0, s, shape) for d in "fb" for k, s, shape in (
        ("x", 0.3, (CHARS, 4 * h)), ("h", 0.25, (h, 4 * h)))}
    for d in "fb":
        m[f"x{d}"][:, h:2 * h] += 1.0  # remember at first
    return m | {"out": r.normal(0, 0.3, (2 * h, TAGS)), "bias": np.zeros(TAGS), "move": np.zeros((TAGS, TAGS))}


def lstm(xw: np.ndarray, wh: np.ndarray, x: np.ndarray):
    """One direction over [T, B] characters; the table ``xw`` is embedding and input weights in one."""
    steps, batch, hid = x.shape[0], x.shape[1], HIDDEN
    h, c = np.zeros((batch, hid)), np.zeros((batch, hid))
    hs, gates, cells = np.empty((steps, batch, hid)), np.empty((steps, batch, 4 * hid)), np.empty((steps, batch, hid))
    for t in range(steps):
        z = xw[x[t]] + h @ wh
        g = sigmoid(z)
        g[:, 3 * hid:] = np.tanh(z[:, 3 * hid:])
        i, f, o, u = (g[:, k * hid:(k + 1) * hid] for k in range(4))
        c = f * c + i * u
        h = o * np.tanh(c)
        hs[t], gates[t], cells[t] = h, g, c
    return hs, gates, cells


def lstm_grad(xw, wh, x, hs, gates, cells, d_hs):
    """Gradients of the table and the recurrent weights."""
    hid, g_wh = HIDDEN, np.zeros_like(wh)
    g_z = np.empty_like(gates)
    dh_next, dc_next = np.zeros_like(hs[0]), np.zeros_like(hs[0])
    for t in range(len(x) - 1, -1, -1):
        i, f, o, u = (gates[t][:, k * hid:(k + 1) * hid] for k in range(4))
        before = cells[t - 1] if t else np.zeros_like(cells[0])
        tc = np.tanh(cells[t])
        dh = d_hs[t] + dh_next
        dc = dh * o * (1 - tc * tc) + dc_next
        dz = np.concatenate([dc * u * i * (1 - i), dc * before * f * (1 - f), dh * tc * o * (1 - o),
                             dc * i * (1 - u * u)], 1)
        g_z[t], dc_next, dh_next = dz, dc * f, dz @ wh.T
        if t:
            g_wh += hs[t - 1].T @ dz
    flat, gx = x.ravel(), np.zeros_like(xw)
    np.add.at(gx, flat, g_z.reshape(len(flat), -1))
    return gx, g_wh


def emissions(m: dict, x: np.ndarray):
    """[B, T] characters -> [T, B, TAGS] scores, and what the gradients need."""
    xt = x.T
    fw = lstm(m["xf"], m["hf"], xt)
    bw = lstm(m["xb"], m["hb"], xt[::-1])
    both = np.concatenate([fw[0], bw[0][::-1]], 2)
    return both @ m["out"] + m["bias"], (xt, fw, bw, both)


def lse(a: np.ndarray, axis: int) -> np.ndarray:
    top = a.max(axis, keepdims=True)
    return (np.log(np.exp(a - top).sum(axis, keepdims=True)) + top).squeeze(axis)


def forward(e: np.ndarray, move: np.ndarray, before: np.ndarray | None = None) -> np.ndarray:
    """Forward scores [T, B, TAGS]; ``before`` are those of the step ahead of the first."""
    alpha = np.empty_like(e)
    alpha[0] = e[0] if before is None else e[0] + lse(before[:, :, None] + move, 1)
    for t in range(1, len(e)):
        alpha[t] = e[t] + lse(alpha[t - 1][:, :, None] + move, 1)
    return alpha


def backward(e: np.ndarray, move: np.ndarray, after: np.ndarray | None = None) -> np.ndarray:
    """Backward scores [T, B, TAGS]; ``after`` are emission plus score of the step behind the last."""
    beta = np.zeros_like(e)
    if after is not None:
        beta[-1] = lse(move + after[:, None, :], 2)
    for t in range(len(e) - 2, -1, -1):
        beta[t] = lse(move + (e[t + 1] + beta[t + 1])[:, None, :], 2)
    return beta


def crf(e: np.ndarray, move: np.ndarray):
    """Forward and backward scores and the log normaliser of [T, B, TAGS] emissions."""
    alpha = forward(e, move)
    return alpha, backward(e, move), lse(alpha[-1], 1)


def best_paths(e: np.ndarray, move: np.ndarray, before: np.ndarray | None = None):
    """Scores of the best paths' ends, and each step's best step before (uint8)."""
    back = np.zeros(e.shape, np.uint8)
    best = before
    for t in range(len(e)):
        if best is None:
            best = e[t]
            continue
        s = best[:, :, None] + move
        back[t] = s.argmax(1)
        best = e[t] + s.max(1)
    return best, back


def decode_blocks(emitted, length: int, move: np.ndarray, block: int) -> tuple[np.ndarray, np.ndarray]:
    """Best tags and their posteriors [T, B]; ``emitted(s, t)`` gives the emissions of [s, t).
    One pass ahead keeps the scores at the blocks' ends, one back fills the blocks."""
    starts = list(range(0, length, block))
    alphas, bests = [None], [None]  # ahead of each block
    for s in starts:
        e = emitted(s, min(s + block, length))
        alphas.append(forward(e, move, alphas[-1])[-1].copy())
        bests.append(best_paths(e, move, bests[-1])[0])
    z = lse(alphas[-1], 1)
    last = bests[-1].argmax(1)
    tags, sure = np.empty((length, len(last)), np.uint8), np.empty((length, len(last)))
    rows, after = np.arange(len(last)), None
    for n in range(len(starts) - 1, -1, -1):
        s, t = starts[n], min(starts[n] + block, length)
        if len(starts) > 1:
            e = emitted(s, t)
        alpha, beta = forward(e, move, alphas[n]), backward(e, move, after)
        _, back = best_paths(e, move, bests[n])
        for i in range(t - s - 1, -1, -1):
            tags[s + i] = last
            last = back[i][rows, last]
        own = tags[s:t, :, None].astype(np.int64)
        sure[s:t] = np.exp(np.take_along_axis(alpha + beta, own, 2)[:, :, 0] - z)
        after = e[0] + beta[0]
    return tags, sure


def tags_of(length: int, spans: list[Span]) -> np.ndarray:
    tags = np.zeros(length, np.int64)
    for kind, a, b in sorted(spans, key=lambda s: s[1] - s[2]):  # shorter ones over longer ones
        tags[a:b] = 2 + 2 * kind
        tags[a] = 1 + 2 * kind
    return tags


def fit(x: np.ndarray, y: np.ndarray, epochs: int = 25, batch: int = 64, seed: int = 5) -> dict:
    """Maximum likelihood by Adam; x, y are [N, WINDOW] characters and tags."""
    m, rng = new_model(), np.random.default_rng(seed)
    mom, step = {k: [np.zeros_like(v), np.zeros_like(v)] for k, v in m.items()}, 0
    for _ in range(epochs):
        order = rng.permutation(len(x))
        for a in range(0, len(x), batch):
            pick = order[a:a + batch]
            e, (xt, fw, bw, both) = emissions(m, x[pick])
            gold, n = y[pick].T, len(pick)
            alpha, beta, z = crf(e, m["move"])
            d_e = np.exp(alpha + beta - z[None, :, None])
            d_e[np.arange(WINDOW)[:, None], np.arange(n)[None], gold] -= 1
            d_e /= n
            pair = np.exp(alpha[:-1, :, :, None] + m["move"] + (e[1:] + beta[1:])[:, :, None, :]
                          - z[None, :, None, None]).sum((0, 1))
            np.add.at(pair, (gold[:-1], gold[1:]), -1)
            d_both = d_e @ m["out"].T
            gxf, ghf = lstm_grad(m["xf"], m["hf"], xt, *fw, d_both[:, :, :HIDDEN])
            gxb, ghb = lstm_grad(m["xb"], m["hb"], xt[::-1], *bw, d_both[::-1, :, HIDDEN:])
            grads = {"xf": gxf, "hf": ghf, "xb": gxb, "hb": ghb, "move": pair / n, "bias": d_e.sum((0, 1)),
                     "out": both.reshape(-1, 2 * HIDDEN).T @ d_e.reshape(-1, TAGS)}
            step += 1
            for k, g in grads.items():
                g = np.clip(g, -5, 5)
                p, q = mom[k]
                p += 0.1 * (g - p)
                q += 0.001 * (g * g - q)
                m[k] -= 0.015 * (p / (1 - 0.9 ** step)) / (np.sqrt(q / (1 - 0.999 ** step)) + 1e-8)
    return {k: v.astype(np.float32) for k, v in m.items()}


def blend(m: dict, codes: list[np.ndarray]) -> list[np.ndarray]:
    """Emissions [T, TAGS] of each region, from its windows."""
    x, region, offset = windows(codes)
    blended = [np.zeros((len(c), TAGS)) for c in codes]
    weight = [np.zeros((len(c), 1)) for c in codes]
    ramp = np.minimum(np.arange(1, WINDOW + 1), np.arange(WINDOW, 0, -1)).astype(float)[:, None]
    for a in range(0, len(x), 512):
        e, _ = emissions(m, x[a:a + 512])
        for k in range(e.shape[1]):
            i, o = region[a + k], offset[a + k]
            n = min(WINDOW, len(codes[i]) - o)
            blended[i][o:o + n] += ramp[:n] * e[:n, k]
            weight[i][o:o + n] += ramp[:n]
    return [b / w for b, w in zip(blended, weight, strict=True)]


def block_emissions(m: dict, code: np.ndarray):
    """s, t -> emissions [t - s, 1, TAGS] of one region's characters, from the windows over them.
    s is a multiple of STRIDE; the step behind the last character is the end."""
    def emitted(s: int, t: int) -> np.ndarray:
        if s == len(code):
            return END
        a = max(0, s - WINDOW + STRIDE)  # the first window that reaches s
        # up to where the last window over t ends; the windows behind it do not reach t
        b = min(len(code), -(-t // STRIDE) * STRIDE + WINDOW)
        e = blend(m, [code[a:b]])[0][s - a:t - a, None]
        return e if t <= len(code) else np.concatenate([e, END])
    return emitted


def decode(m: dict, codes: list[np.ndarray]):
    """(region, tags, their posteriors) of each region, from blended windows and one CRF pass."""
    order = sorted(range(len(codes)), key=lambda i: len(codes[i]))
    short = [i for i in order if len(codes[i]) <= BLOCK]
    at = 0
    while at < len(short):
        group, chars = [], 0
        while at < len(short) and (not group or chars + len(codes[short[at]]) <= GROUP_CHARS):
            group.append(short[at])
            chars += len(codes[short[at]])
            at += 1
        blended = dict(zip(group, blend(m, [codes[i] for i in group]), strict=True))
        while group:
            n = 1
            while n < min(64, len(group)) and (n + 1) * len(codes[group[n]]) <= BATCH_CHARS:
                n += 1
            pick, group = group[:n], group[n:]
            longest = len(codes[pick[-1]]) + 1  # each has an end, so none depends on its batch
            e = np.tile(END, (longest, n, 1))
            for k, i in enumerate(pick):
                e[:len(codes[i]), k] = blended[i]
            tags, sure = decode_blocks(lambda s, t, e=e: e[s:t], longest, m["move"], longest)
            for k, i in enumerate(pick):
                yield i, tags[:len(codes[i]), k], sure[:len(codes[i]), k]
    for i in order[len(short):]:
        tags, sure = decode_blocks(block_emissions(m, codes[i]), len(codes[i]) + 1, m["move"], BLOCK)
        yield i, tags[:-1, 0], sure[:-1, 0]


def new_spans(text: str, at: int, tags: np.ndarray, sure: np.ndarray,
              base: list[Span]) -> list[tuple[float, Span]]:
    """Spans of a region's decoding that are whole and touch no pattern span, with their least posterior."""
    out, i = [], 0
    base = [b for b in base if b[1] < at + len(tags) and b[2] > at]
    while i < len(tags):
        if tags[i] == 0:
            i += 1
            continue
        kind, j = (int(tags[i]) - 1) // 2, i + 1
        while j < len(tags) and tags[j] == 2 + 2 * kind:
            j += 1
        a, b = at + i, at + j
        while a < b and text[a].isspace():
            a += 1
        while b > a and text[b - 1].isspace():
            b -= 1
        if valid(kind, text[a:b]) and not any(s < b and a < e for _, s, e in base):
            out.append((float(sure[i:j].min()), (int(kind), a, b)))
        i = j
    return out


def rewritten(kind: int, s: str, pick: int) -> str:
    """A pattern span in a form that its pattern misses; ``pick`` chooses the form."""
    if kind == 0:  # beside the @, so that no shorter address is left for the pattern
        local, domain = s.split("@", 1)
        wide = WIDE[pick // 2 % len(WIDE)]
        return f"{local}{wide}@{domain}" if pick % 2 else f"{local}@{domain[0]}{wide}{domain[1:]}"
    if kind == 1:
        return s.replace(".", IP_FORMS[pick % len(IP_FORMS)])
    if kind == 2:
        digits = re.sub("[^0-9]", "", s)
        parts = [digits[i:i + 4] for i in range(0, len(digits), 4)]
        return CARD_FORMS[pick % len(CARD_FORMS)].join(parts)
    rest = s[1:].lstrip()
    first = re.match("[0-9]{1,3}", rest).group()
    return (f"00{rest}", f"({first}) {rest[len(first):].lstrip(' ().-')}", f"00 {rest}")[pick % 3]


def altered(ident: str | None, text: str, base: list[Span]) -> tuple[str, list[Span], list[Span]]:
    """The text with its pattern spans rewritten, its spans, and those among them that no pattern finds.
    Rewritten spans that a pattern touches all the same are left to the pattern."""
    parts, put, at, size = [], [], 0, 0
    for n, (kind, a, b) in enumerate(sorted(base, key=lambda s: s[1])):
        if a < at:
            continue
        pick = xxhash.xxh32_intdigest(f"{ident}:{n}:{text[a:b]}".encode("utf-8", "surrogatepass"))
        new = rewritten(kind, text[a:b], pick)
        put.append((kind, size + a - at, size + a - at + len(new)))
        parts += [text[at:a], new]
        size, at = size + a - at + len(new), b
    new_text = "".join([*parts, text[at:]])
    found = base_spans(new_text)
    taken = np.zeros(len(new_text), bool)
    for _, a, b in found:
        taken[a:b] = True
    own = [(k, a, b) for k, a, b in put if not taken[a:b].any() and valid(k, new_text[a:b])]
    return new_text, found + own, own


def hidden_form(s: str) -> bool:
    """Does a text hold a form that the patterns miss, so that it is no example of clean text?"""
    return any(3 <= len(m.group()) <= 200 and valid(kind, m.group())
               for kind, form in enumerate(HIDDEN_FORMS) for m in form.finditer(s))


def training_windows(ident: str | None, text: str) -> Iterator[tuple[int, bool, bytes, bytes, int]]:
    """(rank, labelled, characters, tags, version) of each window of a text's regions, and of each window
    with a rewritten span of its altered text."""
    base = base_spans(text)
    for version, t, spans, own in ((0, text, base, None), (1, *altered(ident, text, base))) if base else (
            (0, text, base, None),):
        found = regions(t) if own is None or own else []
        y = tags_of(len(t), spans) if found else None
        new = tags_of(len(t), own) if found and own else None
        for a, b in found:
            if new is not None and not new[a:b].any():
                continue
            x, _, offset = windows([coded(t[a:b])])
            for k, o in enumerate(offset):
                end = min(a + o + WINDOW, b)
                if new is not None and not new[a + o:end].any():
                    continue
                tags = np.zeros(WINDOW, np.uint8)
                tags[:end - a - o] = y[a + o:end]
                if not tags.any() and hidden_form(t[a + o:end]):
                    continue
                chars = x[k].astype(np.uint8).tobytes()
                key = f"{ident}:{version}:{a + o}:".encode("utf-8", "surrogatepass")
                yield xxhash.xxh64_intdigest(key + chars) - (1 << 63), bool(tags.any()), chars, tags.tobytes(), version


def _ranked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The ``TRAIN_REGIONS`` windows of smallest rank of a task: clean ones (0), labelled ones (1),
    ones with rewritten spans (2)."""
    best: dict[int, set] = {sort: set() for sort in range(3)}
    bound = dict.fromkeys(best, 1 << 63)
    for b in batches:
        for ident, text in zip(b.column("_id").to_pylist(), b.column("_t").to_pylist(), strict=True):
            for rank, labelled, chars, tags, version in training_windows(ident, text) if text else ():
                sort = 2 if version else int(labelled)
                if rank > bound[sort]:
                    continue
                best[sort].add((rank, chars, tags))
                if len(best[sort]) >= 4 * TRAIN_REGIONS:
                    few = sorted(best[sort])[:TRAIN_REGIONS]
                    best[sort], bound[sort] = set(few), few[-1][0]
    for sort, rows in best.items():
        few = sorted(rows)[:TRAIN_REGIONS]
        yield pa.RecordBatch.from_arrays(
            [pa.array([r[0] for r in few], pa.int64()), pa.array([sort] * len(few), pa.int32()),
             pa.array([r[1] for r in few], pa.binary()), pa.array([r[2] for r in few], pa.binary())],
            names=["rank", "sort", "x", "y"])


def training_sample(docs: DataFrame, id_col: str, text_col: str) -> tuple[np.ndarray, np.ndarray]:
    """Characters and tags [N, WINDOW] of the sampled windows."""
    rows = docs.select(F.col(id_col).cast("string").alias("_id"), F.col(text_col).alias("_t"))
    ranked = kept(rows.mapInArrow(_ranked, "rank long, sort int, x binary, y binary"), "pii-windows")
    clean, labelled, new = (ranked.where(F.col("sort") == sort).select("rank", "x", "y").distinct()
                            .orderBy("rank", "x").limit(TRAIN_REGIONS).toPandas() for sort in range(3))
    n_new = min(len(new), max(TRAIN_REGIONS // 5, TRAIN_REGIONS - len(labelled) - len(clean)))
    n = min(len(labelled), max(TRAIN_REGIONS // 2, TRAIN_REGIONS - n_new - len(clean)))
    parts = labelled[:n], new[:n_new], clean[:TRAIN_REGIONS - n - n_new]
    x, y = (np.frombuffer(b"".join(v for p in parts for v in p[c]), np.uint8).reshape(-1, WINDOW).astype(np.int64)
            for c in ("x", "y"))
    return x, y


def confidence(m: dict, x: np.ndarray, y: np.ndarray) -> float:
    """The least posterior at which ``PRECISION`` of the added spans of held-out windows are right;
    2 (nothing is added) where none is enough.  Spans that a window cuts do not count."""
    seen = []
    for k, tags, sure in decode(m, [w[w < CHARS - 1].astype(np.uint8) for w in x]):
        text = "".join(map(chr, x[k][:len(tags)]))
        for p, (kind, a, b) in new_spans(text, 0, tags, sure, base_spans(text)):
            if 0 < a and b < min(len(tags), WINDOW):
                want = np.r_[1 + 2 * kind, np.full(b - a - 1, 2 + 2 * kind)]
                whole = b == len(tags) or y[k, b] != 2 + 2 * kind
                seen.append((p, bool((y[k, a:b] == want).all() and whole)))
    for least in CONFIDENCES:
        right = [ok for p, ok in seen if p >= least]
        if right and np.mean(right) >= PRECISION:
            return least
    return 2.0


def train(docs: DataFrame, id_col: str, text_col: str) -> dict | None:
    """Model from a bounded sample of the regions' windows: one fit on all of them, with the
    confidence of a fit that leaves every fifth window out."""
    x, y = training_sample(docs, id_col, text_col)
    if not (y > 0).any():
        return None
    held = np.arange(len(x)) % 5 == 0
    least = confidence(fit(x[~held], y[~held]), x[held], y[held]) if (y[~held] > 0).any() else 2.0
    return fit(x, y) | {"confidence": least}


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: id, base (pattern spans) and spans (all spans), each an array of
    struct(kind, start, end)."""
    shared = docs.sparkSession.sparkContext.broadcast(train(docs, id_col, text_col))
    rows = docs.select(F.col(id_col), F.col(text_col).alias("_t"))
    span = T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()),
                         T.StructField("end", T.LongType())])

    def make():
        m = shared.value

        def run(texts: list) -> list:
            base = [base_spans(t) if t else [] for t in texts]
            every = [list(b) for b in base]
            where = [(i, a, b) for i, t in enumerate(texts) if t for a, b in regions(t)]
            if m is not None and where:
                found = decode(m, [coded(texts[i][a:b]) for i, a, b in where])
                for r, tags, sure in found:
                    i, a, _ = where[r]
                    every[i] += [s for p, s in new_spans(texts[i], a, tags, sure, base[i]) if p >= m["confidence"]]
            return [[[{"kind": KINDS[k], "start": a, "end": b} for k, a, b in sorted(s)] for s in x]
                    for x in (base, every)]
        return run

    return map_texts(rows, "_t", [T.StructField("base", T.ArrayType(span)),
                                  T.StructField("spans", T.ArrayType(span))], make)
