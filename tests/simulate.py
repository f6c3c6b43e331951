"""Plain simulations that the set formulations are held against."""

from __future__ import annotations

STARTS, STOPS = ("ATG", "GTG", "TTG"), ("TAA", "TAG", "TGA")
PAIR = {"A": "T", "C": "G", "G": "C", "T": "A"}


def revcomp(s: str) -> str:
    return "".join(PAIR.get(c, "N") for c in reversed(s))


def refined(starts, codon_at):
    for p in starts:
        if p - starts[0] > 75:
            break
        if codon_at(p) == "ATG":
            return p
    return starts[0]


def frames(seq: str, minlen: int, circular: bool = False):
    """(t_start, end, len, partial5, partial3) of one strand, walking each frame codon by codon."""
    n = len(seq)
    codon = lambda p: seq[p : p + 3]
    out, pending, first_stop, plain = [], {}, {}, {}
    for phase in range(3):
        starts = []
        plain[phase] = []
        seen_start = False
        for p in range(phase, n - 2, 3):
            if codon(p) in STARTS:
                starts.append(p)
                seen_start = True
            elif codon(p) in STOPS:
                if phase not in first_stop:
                    first_stop[phase] = (p + 3, seen_start)
                if starts:
                    t = refined(starts, codon)
                    if p + 3 - t < minlen:
                        t = starts[0]
                    if p + 3 - t >= minlen:
                        plain[phase].append((t, p + 3, p + 3 - t, False, False))
                starts = []
        pending[phase] = starts
    entered, removed = set(), set()
    for phase, starts in pending.items():
        if not starts:
            continue
        ahead = (phase + (3 - n % 3) % 3) % 3
        t = refined(starts, codon)
        if circular and ahead in first_stop:
            end = first_stop[ahead][0]
            entered.add(ahead)
            for s in (t, starts[0]):
                if n - s + end >= minlen:
                    out.append((s, end, n - s + end, False, False))
                    removed.add((ahead, end))
                    break
            continue
        if n - t < minlen:
            t = starts[0]
        if circular or n - t >= minlen:
            out.append((t, n, (n - t) // 3 * 3, False, True))
    for phase in range(3):
        out += [x for x in plain[phase] if (phase, x[1]) not in removed]
        if phase in first_stop and phase not in entered:
            end, seen = first_stop[phase]
            if not seen and end - phase >= minlen:
                out.append((phase, end, end - phase, True, False))
    return sorted(out)
