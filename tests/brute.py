
import math
import re
from collections import Counter


def tok(s):
    return re.sub(r"[^a-z0-9]+", " ", s.lower()).split()


def grams(t, n):
    return Counter(tuple(t[i:i + n]) for i in range(len(t) - n + 1))


def f(p, r):
    return 0.0 if p + r == 0 else 2 * p * r / (p + r)


def rouge_n(g, h, n):
    tg, th = tok(g), tok(h)
    ov = sum((grams(tg, n) & grams(th, n)).values())
    p = ov / max(len(th) - n + 1, 1)
    r = ov / max(len(tg) - n + 1, 1)
    return p, r, f(p, r)


def lcs(a, b):
    t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            t[i][j] = t[i - 1][j - 1] + 1 if a[i - 1] == b[j - 1] else max(t[i - 1][j], t[i][j - 1])
    return t[len(a)][len(b)]


def rouge_l(g, h):
    tg, th = tok(g), tok(h)
    if not tg or not th:
        return 0.0, 0.0, 0.0
    m = lcs(tg, th)
    p, r = m / len(th), m / len(tg)
    return p, r, f(p, r)


def tok13a(s):
    s = " " + s.replace("\n", " ") + " "
    s = re.sub(r"([\{-\~\[-\` -\&\(-\+\:-\@\/])", r" \1 ", s)
    s = re.sub(r"([^0-9])([\.,])", r"\1 \2 ", s)
    s = re.sub(r"([\.,])([^0-9])", r" \1 \2", s)
    s = re.sub(r"([0-9])(-)", r"\1 \2 ", s)
    return [x for x in s.split(" ") if x]


def bleu(g, h):
    tg, th = tok13a(g), tok13a(h)
    ps = []
    for n in range(1, 5):
        m = sum((grams(tg, n) & grams(th, n)).values())
        tot = max(len(th) - n + 1, 0)
        ps.append(m / tot if tot else 0.0)
    geo = math.exp(sum(math.log(p) for p in ps) / 4) if all(p > 0 for p in ps) else 0.0
    ratio = len(th) / len(tg) if tg else 0.0
    if not th or ratio == 0:
        bp = 0.0
    elif ratio > 1:
        bp = 1.0
    else:
        bp = math.exp(1 - 1 / ratio)
    return geo * bp


def chrf(g, h, order=6, beta=2.0):
    sg, sh = "".join(g.split()), "".join(h.split())
    ps, rs = [], []
    for n in range(1, order + 1):
        cg = Counter(sg[i:i + n] for i in range(len(sg) - n + 1))
        ch = Counter(sh[i:i + n] for i in range(len(sh) - n + 1))
        if not cg or not ch:
            continue
        m = sum((cg & ch).values())
        ps.append(m / sum(ch.values()))
        rs.append(m / sum(cg.values()))
    if not ps:
        return 0.0
    p, r = sum(ps) / len(ps), sum(rs) / len(rs)
    if p + r == 0:
        return 0.0
    b2 = beta * beta
    return 100 * (1 + b2) * p * r / (b2 * p + r)


def meteor(g, h, alpha=0.9, beta=3.0, gamma=0.5):
    tg, th = tok(g), tok(h)
    pos_g, pos_h = {}, {}
    for i, t in enumerate(tg):
        pos_g.setdefault(t, []).append(i)
    for i, t in enumerate(th):
        pos_h.setdefault(t, []).append(i)
    matches = []
    for t, hp in pos_h.items():
        gp = pos_g.get(t, [])
        for k in range(1, min(len(hp), len(gp)) + 1):
            matches.append((hp[-k], gp[-k]))
    m = len(matches)
    if m == 0:
        return 0.0
    matches.sort()
    chunks = 1 + sum(1 for a, b in zip(matches, matches[1:])
                     if not (b[0] - a[0] == 1 and b[1] - a[1] == 1))
    p, r = m / len(th), m / len(tg)
    fm = p * r / (alpha * p + (1 - alpha) * r)
    return fm * (1 - gamma * (chunks / m) ** beta)
