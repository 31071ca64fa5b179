"""Numerical kernels on one array: recursive filters, analytic signals, short-time spectra, wavelets, mode decomposition.

Each is a small helper of a Spark operator that maps it over array rows; what relates rows stays in Spark.
"""

from __future__ import annotations

import functools
import math

import numpy as np

# --- zero-phase band-pass ----------------------------------------------------------------------------------------------


@functools.lru_cache(maxsize=64)
def bandpass_sections(low: float, high: float, fs: float, order: int) -> tuple[tuple[float, ...], ...]:
    """Second-order sections (b0, b1, b2, a1, a2) of a Butterworth band-pass, unit gain at the centre."""
    if not 0 < low < high < fs / 2:
        raise ValueError("0 < low < high < fs / 2 is needed")
    warp = lambda f: 2 * fs * math.tan(math.pi * f / fs)
    w1, w2 = warp(low), warp(high)
    centre, width = math.sqrt(w1 * w2), w2 - w1
    poles = []
    for k in range(order):
        p = np.exp(1j * math.pi * (2 * k + order + 1) / (2 * order)) * width / 2
        root = np.sqrt(p * p - centre * centre)
        poles += [p + root, p - root]
    z = [(2 * fs + p) / (2 * fs - p) for p in poles]
    upper = sorted((x for x in z if x.imag > 1e-12), key=lambda x: abs(x))
    real = sorted((x.real for x in z if abs(x.imag) <= 1e-12), key=abs)
    dens = [(-2 * x.real, abs(x) ** 2) for x in upper] + [(-(real[i] + real[i + 1]), real[i] * real[i + 1]) for i in range(0, len(real) - 1, 2)]
    point = np.exp(-1j * 2 * math.atan(centre / (2 * fs)))
    return tuple((g, 0.0, -g, a1, a2) for a1, a2 in dens for g in [abs((1 + a1 * point + a2 * point**2) / (1 - point**2))])


@functools.lru_cache(maxsize=64)
def _block_form(s: tuple[float, ...], size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """A section over a block of samples as matrices: outputs from inputs and state, next state from inputs and state."""
    b0, b1, b2, a1, a2 = s
    step = np.array([[-a1, 1.0], [-a2, 0.0]])
    into = np.array([b1 - a1 * b0, b2 - a2 * b0])
    powers = [np.eye(2)]
    for _ in range(size):
        powers.append(powers[-1] @ step)
    reply = np.array([b0] + [(powers[k] @ into)[0] for k in range(size - 1)])
    lag = np.arange(size)[:, None] - np.arange(size)[None, :]
    outputs = np.where(lag >= 0, reply[np.maximum(lag, 0)], 0.0)
    return outputs, np.array([p[0] for p in powers[:size]]), np.array([powers[size - 1 - k] @ into for k in range(size)]).T, powers[size]


def _section(x: np.ndarray, s: tuple[float, ...], state: float, size: int = 64) -> np.ndarray:
    """One section, started as if the signal had always been `state`; samples go in blocks."""
    b0, b1, b2, a1, a2 = s
    gain = (b0 + b1 + b2) / (1 + a1 + a2)
    z = np.array([(gain - b0) * state, (b2 - a2 * gain) * state])
    outputs, from_state, feed, carry = _block_form(s, size)
    blocks = np.concatenate([x, np.zeros(-len(x) % size)]).reshape(-1, size)
    fed = blocks @ feed.T
    states = np.empty((len(blocks), 2))
    for i in range(len(blocks)):
        states[i] = z
        z = carry @ z + fed[i]
    return (blocks @ outputs.T + states @ from_state.T).reshape(-1)[: len(x)]


def bandpass(x: np.ndarray, low: float, high: float, fs: float, order: int = 4) -> np.ndarray:
    """Forward and backward filtering with odd extension at both ends."""
    sections = bandpass_sections(low, high, fs, order)
    pad = min(3 * (2 * len(sections) + 1), len(x) - 1)
    if pad < 1:
        raise ValueError("the signal is too short to filter")
    y = np.concatenate([2 * x[0] - x[pad:0:-1], x, 2 * x[-1] - x[-2 : -pad - 2 : -1]])
    for _ in range(2):
        for s in sections:
            y = _section(y, s, y[0])
        y = y[::-1]
    return y[pad : pad + len(x)].copy()


def detrend(x: np.ndarray) -> np.ndarray:
    n = np.arange(len(x)) - (len(x) - 1) / 2
    return x - x.mean() - n * (n @ x) / max(n @ n, 1e-300)


# --- analytic signal and short-time spectra ----------------------------------------------------------------------------


def envelope(x: np.ndarray) -> np.ndarray:
    """Magnitude of the analytic signal."""
    n = len(x)
    h = np.zeros(n)
    h[0] = 1
    h[1 : (n + 1) // 2] = 2
    if n % 2 == 0:
        h[n // 2] = 1
    return np.abs(np.fft.ifft(np.fft.fft(x) * h))


def energy_growth(x: np.ndarray, fs: float, smooth_s: float = 0.01) -> float | None:
    """Mean positive slope of the smoothed squared envelope, without the smoothing's edges."""
    if len(x) < 2:
        return None
    e = envelope(x) ** 2
    length = min(len(e), max(3, round(smooth_s * fs)))
    s = np.convolve(e, np.ones(length) / length, mode="same")
    d = np.gradient(s, 1 / fs)
    cut = length // 2
    d = d[cut:-cut] if 0 < 2 * cut < len(d) else d
    return float(np.maximum(d, 0).mean())


def short_time_energy(x: np.ndarray, fs: float, seconds: float = 0.05) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Frame times, frequencies and energies (frames, bins); half-overlapping Hann frames, no padding."""
    n = min(len(x), max(32, round(seconds * fs)))
    step = n - n // 2
    w = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(n) / n)
    frames = np.lib.stride_tricks.sliding_window_view(x, n)[::step]
    z = np.fft.rfft(frames * w, axis=1) / w.sum()
    return (np.arange(len(frames)) * step + n / 2) / fs, np.fft.rfftfreq(n, 1 / fs), np.abs(z) ** 2


# --- wavelets ----------------------------------------------------------------------------------------------------------


@functools.lru_cache(maxsize=32)
def daubechies(order: int) -> tuple[float, ...]:
    """Low-pass decomposition filter of dbN: the minimum-phase spectral factor of the half-band polynomial."""
    if not 1 <= order <= 20:
        raise ValueError("db1 to db20 are known")
    roots = np.roots([math.comb(order - 1 + k, k) for k in range(order - 1, -1, -1)]) if order > 1 else np.empty(0)
    z = []
    for y in roots:  # y = (2 - z - 1/z) / 4
        b = 1 - 2 * y
        pair = np.array([b + np.sqrt(b * b - 1 + 0j), b - np.sqrt(b * b - 1 + 0j)])
        z.append(pair[np.abs(pair).argmin()])
    h = np.real(np.poly(np.concatenate([np.full(order, -1.0), z])))
    return tuple(float(v) for v in (h / h.sum() * math.sqrt(2))[::-1])


def filters(name: str) -> tuple[np.ndarray, np.ndarray]:
    if not name.startswith("db") or not name[2:].isdigit():
        raise ValueError(f"unknown wavelet {name}; dbN is supported")
    lo = np.array(daubechies(int(name[2:])))
    return lo, np.array([(-1) ** (k + 1) * v for k, v in enumerate(lo[::-1])])


def _mirror(x: np.ndarray, pad: int) -> np.ndarray:
    return x[np.abs((np.arange(-pad, len(x) + pad) + len(x)) % (2 * len(x)) - len(x) + 0.5).astype(np.int64)] if len(x) else x


def dwt(x: np.ndarray, name: str, level: int) -> list[tuple[str, int, np.ndarray]]:
    """Bands (name, level, coefficients), coarse to fine, with half-sample symmetric ends; the level is capped by the length."""
    lo, hi = filters(name)
    top = max(0, int(math.log2(max(1, len(x)) / (len(lo) - 1)))) if len(lo) > 1 else level
    level = min(level, top) if top else 0
    bands = []
    a = np.asarray(x, dtype=np.float64)
    for j in range(1, level + 1):
        ext = _mirror(a, len(lo) - 1)
        bands.append((f"cD{j}", j, np.convolve(ext, hi, mode="valid")[1::2]))
        a = np.convolve(ext, lo, mode="valid")[1::2]
    return [(f"cA{level}", level, a), *bands[::-1]]


def idwt(bands: list[np.ndarray], name: str, n: int) -> np.ndarray:
    """Inverse of dwt (coarse to fine), cut or edge-padded to n samples."""
    lo, hi = (f[::-1] for f in filters(name))
    a = bands[0]
    for d in bands[1:]:
        a = a[: len(d)]
        up = np.zeros((2, 2 * len(d) - 1))
        up[0, ::2], up[1, ::2] = a, d
        a = (np.convolve(up[0], lo) + np.convolve(up[1], hi))[len(lo) - 2 : 2 * len(d)]
    return a[:n] if len(a) >= n else np.pad(a, (0, n - len(a)), mode="edge")


def shrink_threshold(d: np.ndarray, sigma: float) -> float:
    """sigma^2 over the signal's deviation; the largest magnitude where no signal stands out."""
    signal = math.sqrt(max(0.0, float((d * d).mean()) - sigma * sigma)) if len(d) else 0.0
    return sigma * sigma / signal if signal > 2.220446049250313e-16 else float(np.abs(d).max(initial=0.0))


def wavelet_denoise(x: np.ndarray, name: str, level: int, fs: float, band: tuple[float, float] | None, least_sigma: float = 1e-12, mode: str = "soft") -> np.ndarray:
    """Soft or hard thresholds per detail band, gentler the more the band overlaps the given one (0.5, 1.4 and 0.6745 are fixed values)."""
    if mode not in ("soft", "hard"):
        raise ValueError(f"unknown threshold mode {mode}")
    bands = dwt(x, name, level)
    if len(bands) < 2:
        return np.array(x)
    fine = bands[-1][2]
    sigma = max(least_sigma, float(np.median(np.abs(fine - np.median(fine)))) / 0.6745)
    out = [bands[0][2]]
    for _, j, d in bands[1:]:
        lo, hi = fs * 2.0 ** -(j + 1), fs * 2.0**-j
        q = min(1.0, max(0.0, (min(hi, band[1]) - max(lo, band[0])) / (hi - lo))) if band else None
        t = shrink_threshold(d, sigma) * (1.0 if q is None else 0.5 * q + 1.4 * (1 - q))
        out.append(np.sign(d) * np.maximum(np.abs(d) - t, 0) if mode == "soft" else np.where(np.abs(d) >= t, d, 0.0))
    return idwt(out, name, len(x))


# --- mode decomposition ------------------------------------------------------------------------------------------------


#: Samples (trials times length) that one batch of trials holds; of several signals' batches that are worked on together; and that are sifted at once, small enough for a core's cache.
BATCH, CHUNK, BLOCK = 2_000_000, 400_000, 32_000
BLOCKS_KEPT = 32_000_000


def _tridiagonal(g: np.ndarray, d: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Solves rows g[i] x[i-1] + 2 (g[i] + g[i+1]) x[i] + g[i+1] x[i+1] = d[i], a system in each column, without x before the first row and behind the row last of a column; in place of d.

    By elimination in order where columns are many, else of neighbours at distances 1, 2, 4, ..; what is left of them falls below rounding after a few steps.
    """
    b = g[:-1] + g[1:]
    b *= 2
    every = np.arange(b.shape[1])
    if b.shape[1] >= 64:
        c, one, two = np.empty_like(b), np.empty(b.shape[1]), np.empty(b.shape[1])
        np.divide(1.0, b[0], out=one)
        np.multiply(g[1], one, out=c[0])
        d[0] *= one
        for i in range(1, len(b)):
            np.multiply(g[i], c[i - 1], out=one)
            np.subtract(b[i], one, out=one)
            np.divide(1.0, one, out=one)
            np.multiply(g[i + 1], one, out=c[i])
            np.multiply(g[i], d[i - 1], out=two)
            np.subtract(d[i], two, out=two)
            np.multiply(two, one, out=d[i])
        c[last, every] = 0.0
        for i in range(len(b) - 2, -1, -1):
            np.multiply(c[i], d[i + 1], out=one)
            d[i] -= one
        return d
    a, c = g[:-1].copy(), g[1:].copy()
    a[0], c[-1] = 0.0, 0.0
    inner = np.arange(len(b))[:, None] <= last
    a *= inner
    c *= inner
    c[last, every] = 0.0
    d *= inner
    step = 1
    while step < len(b) and max(np.abs(a / b).max(), np.abs(c / b).max()) > 1e-17:
        down, up = np.zeros_like(b), np.zeros_like(b)
        down[step:] = -a[step:] / b[:-step]
        up[:-step] = -c[:-step] / b[step:]
        new = [np.zeros_like(a), b.copy(), np.zeros_like(c), d.copy()]
        new[0][step:] = down[step:] * a[:-step]
        new[1][step:] += down[step:] * c[:-step]
        new[1][:-step] += up[:-step] * a[step:]
        new[2][:-step] = up[:-step] * c[step:]
        new[3][step:] += down[step:] * d[:-step]
        new[3][:-step] += up[:-step] * d[step:]
        a, b, c, d = new
        step *= 2
    return d / b


def _pieces(mark: np.ndarray) -> np.ndarray:
    """The number of marks up to each sample of a column, times the columns, plus the column's: the place of the spline's piece that the sample lies in."""
    columns = mark.shape[1]
    piece = np.multiply(mark, columns, dtype=np.intp)
    piece[0] += np.arange(columns)
    if columns >= 256:
        for i in range(1, len(mark)):
            piece[i] += piece[i - 1]
    else:
        np.cumsum(piece, axis=0, out=piece)
    return piece


def _splines(mark: np.ndarray, piece: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Natural cubic splines through the marked samples of each column of h, two of them mirrored at both ends."""
    n, columns = h.shape
    count = piece[-1] // columns
    most = int(count.max()) + 4
    column = np.arange(columns)
    marked = np.flatnonzero(mark)
    to = piece.take(marked)
    at, v = np.empty((most, columns)), np.zeros((most, columns))
    at[:] = 4.0 * n + np.arange(most)[:, None]  # what lies behind a column's last knot is never read
    at[1:].reshape(-1)[to], v[1:].reshape(-1)[to] = marked // columns, h.take(marked)
    for knot, source, shift in ((0, 3, 0), (1, 2, 0), (count + 2, count + 1, 2 * (n - 1)), (count + 3, count, 2 * (n - 1))):
        at[knot, column], v[knot, column] = shift - at[source, column], v[source, column]
    gap, slope = at[1:] - at[:-1], v[1:] - v[:-1]
    part = 1.0 / gap
    slope *= part
    third = _tridiagonal(gap, slope[1:] - slope[:-1], count + 1)  # of the half second derivatives, which are 0 at a column's first and last knot
    # of the pieces from the second knot on: nothing lies before it
    cubic = third[1:] - third[:-1]
    cubic *= part[1:-1]
    linear, own = 2 * third[:-1], third[:-1]
    linear += third[1:]
    linear *= gap[1:-1]
    np.subtract(slope[1:-1], linear, out=linear)
    square = 3 * own
    x, held = np.empty((n, columns)), np.empty((n, columns))
    at[1:-2].take(piece, mode="clip", out=held)  # clip: no check of each place
    np.subtract(np.arange(float(n))[:, None], held, out=x)
    out = cubic.take(piece, mode="clip")
    for c in (square, linear, v[1:-2]):
        out *= x
        c.take(piece, mode="clip", out=held)
        out += held
    return out


def _extrema(h: np.ndarray) -> np.ndarray:
    """Marks of each column's maxima, and beside them of each one's minima."""
    n, columns = h.shape
    d = h[1:] - h[:-1]
    up, down = d > 0, d < 0
    mark = np.empty((n, 2 * columns), dtype=bool)
    mark[0], mark[-1] = False, False
    np.greater(up[:-1], up[1:], out=mark[1:-1, :columns])
    np.greater(down[:-1], down[1:], out=mark[1:-1, columns:])
    return mark


def _oscillates(count: np.ndarray) -> np.ndarray:
    """Which columns have two maxima and minima, from the numbers of _extrema's marks."""
    return (count.reshape(2, -1) >= 2).all(axis=0)


def sifted(h: np.ndarray, sifts: int) -> np.ndarray:
    """Takes the fastest oscillation's local means off each column of h, in place, a number of times; which columns have the extrema for one."""
    columns = max(64, BLOCK // max(1, len(h)))
    if h.shape[1] > columns:
        found = []
        for start in range(0, h.shape[1], columns):
            part = h[:, start : start + columns].copy()
            found.append(sifted(part, sifts))
            h[:, start : start + columns] = part
        return np.concatenate(found)
    found = np.zeros(h.shape[1], dtype=bool)
    live, part = np.arange(h.shape[1]), h
    for k in range(sifts):
        if len(h) < 3:
            break
        mark = _extrema(part)
        piece = _pieces(mark)
        enough = _oscillates(piece[-1] // len(piece[-1]))
        if not enough.all():
            if part is not h:
                h[:, live] = part
            live, mark = live[enough], mark[:, np.tile(enough, 2)]
            part = h[:, live]
            if not len(live):
                break
            piece = _pieces(mark)
        if k == 0:
            found[live] = True
        both = _splines(mark, piece, np.concatenate([part, part], axis=1))
        mean = both[:, : len(live)]
        mean += both[:, len(live) :]
        mean /= 2
        part -= mean
    if part is not h:
        h[:, live] = part
    return found


def _spline_rows(mark: np.ndarray, h: np.ndarray) -> np.ndarray:
    """The splines through the marked samples of each row."""
    marks = mark.T.copy()
    return _splines(marks, _pieces(marks), h.T.copy()).T


def local_means(x: np.ndarray, sifts: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each row what a number of sifts leaves below the fastest oscillation, and which rows have the extrema for one."""
    fast = np.array(x.T, dtype=np.float64)
    found = sifted(fast, sifts)
    return x - fast.T, found


class NoiseModes:
    """Modes (samples, trials) of the trials' white noise, of unit deviation, worked out as far as they are asked for; zeros where a noise has no more."""

    def __init__(self, n: int, trials: int, seed: int, sifts: int) -> None:
        np.empty(BLOCKS_KEPT, dtype=np.uint8)  # once a large block is freed, the allocator keeps smaller ones instead of returning them at each step
        self.rest = np.array([np.random.default_rng((seed, i)).normal(size=n) for i in range(trials)]).T.copy()
        self.sifts, self.modes = sifts, []

    def mode(self, k: int) -> np.ndarray:
        while len(self.modes) <= k:
            e = self.rest.copy()
            e *= sifted(e, self.sifts)
            self.rest = self.rest - e
            self.modes.append(e / np.maximum(e.std(axis=0), 1e-300))
        return self.modes[k]


def ensemble_modes(x: np.ndarray, trials: int = 300, epsilon: float = 0.05, seed: int = 1, sifts: int = 16, max_modes: int = -1) -> list[np.ndarray]:
    """Modes by complete ensemble decomposition with adaptive noise, residual last: their sum is x up to rounding.

    Each mode is the residue less the mean of local means of noisy copies; the k-th step adds the noise's k-th mode. Without a largest
    number of modes (max_modes < 0) it goes on until the residue has no two maxima and minima. Trials are worked on in batches.
    """
    return ensembles(np.asarray(x, dtype=np.float64)[None], trials, epsilon, seed, sifts, max_modes)[0]


def ensembles(signals: np.ndarray, trials: int = 300, epsilon: float = 0.05, seed: int = 1, sifts: int = 16, max_modes: int = -1) -> list[list[np.ndarray]]:
    """ensemble_modes of each row of signals; the copies of many rows are sifted at once."""
    n = signals.shape[1]
    size = max(1, BATCH // max(1, n))
    noise = [_noise(n, min(size, trials - i), seed + 7919 * i, sifts) for i in range(0, trials, size)]
    together = max(1, CHUNK // max(1, n * min(size, trials)))
    out = []
    for start in range(0, len(signals), together):
        out += _ensembles(np.array(signals[start : start + together].T, dtype=np.float64), noise, epsilon, sifts, max_modes)
    return out


def _ensembles(residue: np.ndarray, noise: list[NoiseModes], epsilon: float, sifts: int, max_modes: int) -> list[list[np.ndarray]]:
    n, rows = residue.shape
    out: list[list[np.ndarray]] = [[] for _ in range(rows)]
    live, k = np.arange(rows), 0
    while len(live) and (max_modes < 0 or k < max_modes):
        live = live[_oscillates(np.count_nonzero(_extrema(residue[:, live]), axis=0))]
        if not len(live):
            break
        now = residue[:, live]
        beta = epsilon * now.T.std(axis=1)
        total, count = np.zeros((n, len(live))), np.zeros(len(live), dtype=np.int64)
        for w in noise:
            mode = w.mode(k)
            copies = (now[:, :, None] + beta[:, None] * mode[:, None, :]).reshape(n, -1)
            fast = copies.copy()
            found = sifted(fast, sifts)
            copies -= fast
            copies *= found
            total += copies.reshape(n, len(live), -1).sum(axis=2)
            count += found.reshape(len(live), -1).sum(axis=1)
        some = count > 0
        live, now, total, count = live[some], now[:, some], total[:, some], count[some]
        mean = total / count
        for i, r in enumerate(live):
            out[r].append(now[:, i] - mean[:, i])
        residue[:, live] = mean
        k += 1
    return [[*modes, residue[:, r].copy()] for r, modes in enumerate(out)]


@functools.lru_cache(maxsize=4)
def _noise(n: int, trials: int, seed: int, sifts: int) -> NoiseModes:
    return NoiseModes(n, trials, seed, sifts)


# --- assignment --------------------------------------------------------------------------------------------------------


def assign(cost: np.ndarray) -> list[tuple[int, int]]:
    """Pairs (row, column) of a least-cost assignment, by shortest augmenting paths."""
    flip = cost.shape[0] > cost.shape[1]
    c = cost.T if flip else cost
    n, m = c.shape
    u, v, match = np.zeros(n + 1), np.zeros(m + 1), np.zeros(m + 1, dtype=np.int64)
    for i in range(1, n + 1):
        match[0], j0 = i, 0
        least, before, used = np.full(m + 1, np.inf), np.zeros(m + 1, dtype=np.int64), np.zeros(m + 1, dtype=bool)
        while True:
            used[j0] = True
            i0 = match[j0]
            gap = c[i0 - 1] - u[i0] - v[1:]
            better = ~used[1:] & (gap < least[1:])
            least[1:][better], before[1:][better] = gap[better], j0
            j1 = 1 + int(np.where(used[1:], np.inf, least[1:]).argmin())
            delta = least[j1]
            u[match[used]] += delta
            v[used] -= delta
            least[~used] -= delta
            j0 = j1
            if not match[j0]:
                break
        while j0:
            match[j0], j0 = match[before[j0]], before[j0]
    pairs = [(int(match[j]) - 1, j - 1) for j in range(1, m + 1) if match[j]]
    return sorted((b, a) if flip else (a, b) for a, b in pairs)
