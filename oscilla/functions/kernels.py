"""NumPy kernels of the operators that have no relational form; each works on one trace or one small matrix."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np

EPS = 2.220446049250313e-16
DENSE = 1024  # samples up to which tapers come from the whole matrix


# --- finite impulse response -------------------------------------------------


def fir_length(sr: float, low: float, n: int, order: int | None = None) -> int:
    """Odd number of taps; under 3 the filter leaves a signal as it is."""
    if order is None:
        order = min(round(3 * sr / max(low, 0.5)), n - 1)
        order += order % 2 == 0
    order = min(order, n - 1)
    return order if order < 3 else order + (order % 2 == 0)


def _sinc(f: float, m: np.ndarray) -> np.ndarray:
    return 2 * f * np.sinc(2 * f * m)


def fir_taps(kind: str, sr: float, low: float | None, high: float | None, taps: int) -> np.ndarray:
    """Hamming-windowed sinc: bandpass, lowpass (high), highpass (low) or notch (low to high)."""
    m = np.arange(taps) - (taps - 1) // 2
    w = 0.54 - 0.46 * np.cos(2 * np.pi * np.arange(taps) / (taps - 1))
    middle = (np.arange(taps) == (taps - 1) // 2).astype(float)
    if kind in ("lowpass", "highpass"):
        h = _sinc((high if kind == "lowpass" else low) / sr, m) * w
        h = h / h.sum()
        return h if kind == "lowpass" else middle - h
    h = (_sinc(high / sr, m) - _sinc(low / sr, m)) * w
    gain = float((h * np.cos(2 * np.pi * (low + high) / 2 / sr * m)).sum())
    h = h / gain if abs(gain) > 1e-10 else h
    return h if kind == "bandpass" else middle - h


def convolve_valid(x: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Centred convolution along the last axis where the taps fit, by FFT."""
    n = x.shape[-1] + len(h) - 1
    size = 1 << (n - 1).bit_length()
    return np.fft.irfft(np.fft.rfft(x, size) * np.fft.rfft(h, size), size)[..., len(h) - 1 : x.shape[-1]]


def fir(x: np.ndarray, kind: str, sr: float, low: float | None = None, high: float | None = None, order: int | None = None) -> np.ndarray:
    """Zero-phase filter of whole traces along the last axis, ends held."""
    if kind == "notch" and (low <= 0 or high >= sr / 2):
        return x
    taps = fir_length(sr, high if kind == "lowpass" else low, x.shape[-1], order)
    if taps < 3:
        return x
    half = (taps - 1) // 2
    return convolve_valid(np.pad(x, [*[(0, 0)] * (x.ndim - 1), (half, half)], mode="edge"), fir_taps(kind, sr, low, high, taps))


# --- Butterworth --------------------------------------------------------------


def butterworth(order: int, sr: float, low: float | None, high: float | None) -> np.ndarray:
    """Second-order sections (section, b0 b1 b2 a0 a1 a2) by the bilinear transform of the analogue prototype."""
    poles = np.exp(1j * np.pi * (2 * np.arange(1, order + 1) + order - 1) / (2 * order))
    warp = lambda f: 2 * sr * math.tan(math.pi * f / sr)
    if low and high:
        w0, bw = math.sqrt(warp(low) * warp(high)), warp(high) - warp(low)
        half = poles * bw / 2
        root = np.sqrt(half**2 - w0**2)
        p, z, k = np.concatenate([half + root, half - root]), np.zeros(order), bw**order
    elif high:
        p, z, k = poles * warp(high), np.zeros(0), warp(high) ** order
    else:
        p, z, k = warp(low) / poles, np.zeros(order), float(np.real(1 / np.prod(-poles)))
    to = lambda s: (2 * sr + s) / (2 * sr - s)
    k = k * np.real(np.prod(2 * sr - z) / np.prod(2 * sr - p))
    ends = [1.0] * len(z) + [-1.0] * (len(p) - len(z))  # zeros lie at both ends of the band or at one
    real = np.abs(p.imag) < 1e-9 * np.abs(p)
    upper, lone = to(p[~real & (p.imag > 0)]), np.sort(to(p[real]).real)
    pairs = [[1.0, -2 * x.real, abs(x) ** 2] for x in upper]
    pairs += [[1.0, -a - b, a * b] for a, b in zip(lone[::2], lone[1::2])] + [[1.0, -x, 0.0] for x in lone[len(lone) // 2 * 2 :]]
    sections = []
    for a in sorted(pairs, key=lambda a: a[2]):
        if a[2] == 0.0:
            b = [1.0, -ends.pop(), 0.0]
        else:  # one from each end where there are two
            x, y = ends.pop(0), ends.pop()
            b = [1.0, -x - y, x * y]
        sections.append([*b, *a])
    out = np.array(sections)
    out[:, :3] *= np.sign(k) * abs(k) ** (1 / len(out)) if len(out) % 2 or k > 0 else abs(k) ** (1 / len(out))
    return out


def section(b: np.ndarray, a: np.ndarray, x: np.ndarray, state: np.ndarray, block: int = 256) -> tuple[np.ndarray, np.ndarray]:
    """A second-order section over x from a state (transposed direct form), in blocks: output and last state.

    Within a block the output is a matrix product of the inputs plus the state's decay;
    only the two numbers of the state pass from block to block.
    """
    step = np.array([[-a[1], 1.0], [-a[2], 0.0]])
    gain = np.array([b[1] - a[1] * b[0], b[2] - a[2] * b[0]])
    powers = [np.eye(2)]
    for _ in range(block):
        powers.append(step @ powers[-1])
    powers = np.array(powers)
    impulse = np.concatenate([[b[0]], powers[:-1, 0, :] @ gain])[:block]
    lag = np.subtract.outer(np.arange(block), np.arange(block))
    forced = np.where(lag >= 0, impulse[np.maximum(lag, 0)], 0.0)
    full, rest = len(x) // block, len(x) % block
    rows = np.pad(x, (0, -len(x) % block)).reshape(-1, block)
    reach = powers[block - 1 :: -1] @ gain
    pushed = rows[:full] @ reach[:block]
    states = np.empty((len(rows), 2))
    for i, new in enumerate(pushed):
        states[i] = state
        state = powers[block] @ state + new
    if rest:
        states[full] = state
        state = powers[rest] @ state + rows[full, :rest] @ (powers[rest - 1 :: -1] @ gain)[:rest]
    return (rows @ forced.T + states @ powers[:block, 0, :].T).ravel()[: len(x)], state


def cascade(x: np.ndarray, sections: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sections one after another over x from a state of two numbers each: output and last state."""
    last = []
    for i, f in enumerate(sections):
        x, end = section(f[:3], f[3:], x, state[2 * i : 2 * i + 2])
        last.append(end)
    return x, np.concatenate(last)


def cascade_decay(sections: np.ndarray, n: int) -> np.ndarray:
    """The state after n samples of silence is this matrix times the state before."""
    return np.stack([cascade(np.zeros(n), sections, unit)[1] for unit in np.eye(2 * len(sections))], axis=1)


def steady_state(sections: np.ndarray) -> np.ndarray:
    """The state in which a constant 1 has always come in."""
    out, level = [], 1.0
    for f in sections:
        b, a = f[:3], f[3:]
        settle = np.array([[1 + a[1], -1.0], [a[2], 1.0]])
        out.append(np.linalg.solve(settle, b[1:] - a[1:] * b[0]) * level)
        level *= b.sum() / a.sum()
    return np.concatenate(out)


def forward_backward(x: np.ndarray, sections: np.ndarray) -> np.ndarray:
    """Both directions, odd extension at the ends, started in the steady state."""
    pad = min(3 * (2 * len(sections) + 1), len(x) - 1)
    y = np.concatenate([2 * x[0] - x[pad:0:-1], x, 2 * x[-1] - x[-2 : -pad - 2 : -1]]) if pad else x
    for _ in range(2):
        y = cascade(y, sections, steady_state(sections) * y[0])[0][::-1]
    return y[pad : pad + len(x)] if pad else y


# --- analytic signal, wavelets, tapers ----------------------------------------


def morlet_kernel(sr: float, f: float, n_cycles: float) -> np.ndarray:
    """Unit-energy wavelet of odd length."""
    sigma = n_cycles / (2 * np.pi * f)
    half = math.ceil(3 * sigma * sr)
    t = np.arange(-half, half + 1) / sr
    w = np.exp(2j * np.pi * f * t - t**2 / (2 * sigma**2))
    return w / np.sqrt((np.abs(w) ** 2).sum())


def correlate_valid(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Products of x with the conjugate of w where w fits, by FFT."""
    size = 1 << (len(x) - 1).bit_length()
    return np.fft.ifft(np.fft.fft(x, size) * np.conj(np.fft.fft(w, size)))[: len(x) - len(w) + 1]


def morlet(x: np.ndarray, sr: float, freqs: list[float], n_cycles: float, align: str = "centered") -> np.ndarray:
    """Complex coefficients (frequency, time) of unit-energy wavelets.

    align "centered" puts a coefficient at the middle of its wavelet; "reference" keeps the
    shift by twice the half length (with wrap-around) that other implementations show.
    """
    out = np.empty((len(freqs), len(x)), dtype=complex)
    for i, f in enumerate(freqs):
        w = morlet_kernel(sr, f, n_cycles)
        half = len(w) // 2
        size = 1 << (len(x) + len(w) - 2).bit_length()
        full = np.fft.ifft(np.fft.fft(x, size) * np.conj(np.fft.fft(w, size)))
        start = half if align == "reference" else -half
        out[i] = full[(np.arange(len(x)) + start) % size]
    return out


def dpss_at(n: int, nw: float, k: int) -> Callable[[np.ndarray], np.ndarray]:
    """k Slepian tapers of n samples as a function of places from 0: (taper, place); the first element is not negative.

    Short ones are eigenvectors of the tridiagonal matrix. Long ones are smooth, so they are
    solved for among polynomials that are orthonormal on the places: there the matrix, less a
    constant, is minus half j (j + 1) on the diagonal (differences of neighbours) and minus a
    multiple of the square of the places' own tridiagonal matrix (the parabola). Nothing of
    the length of the signal is made but at the places asked for.
    """
    w = nw / n
    terms = 48 + 6 * math.ceil(nw)
    if n <= max(DENSE, terms * terms // 3):
        i = np.arange(n)
        off = i[1:] * (n - i[1:]) / 2
        _, vectors = np.linalg.eigh(np.diag(((n - 1 - 2 * i) / 2) ** 2 * math.cos(2 * math.pi * w)) + np.diag(off, 1) + np.diag(off, -1))
        whole = vectors[:, ::-1][:, :k].T
        whole = np.where(whole[:, :1] < 0, -whole, whole)
        return lambda places: whole[:, places]
    j = np.arange(1, terms + 2, dtype=float)
    beta = np.sqrt(j**2 * (float(n) ** 2 - j**2) / (4 * (4 * j**2 - 1)))  # neighbours in the places' matrix
    places_matrix = np.diag(beta, 1) + np.diag(beta, -1)
    degree = np.arange(terms)
    _, vectors = np.linalg.eigh(-np.diag(degree * (degree + 1) / 2) - 2 * math.sin(math.pi * w) ** 2 * (places_matrix @ places_matrix)[:terms, :terms])
    weights = vectors[:, ::-1][:, :k].T

    def values(places: np.ndarray, weights: np.ndarray) -> np.ndarray:
        y = np.asarray(places) - (n - 1) / 2
        before, now = np.zeros(len(y)), np.full(len(y), 1 / math.sqrt(n))
        out = weights[:, :1] * now
        for m in range(1, terms):
            before, now = now, (y * now - (beta[m - 2] * before if m > 1 else 0)) / beta[m - 1]
            out += weights[:, m : m + 1] * now
        return out

    weights = np.where(values(np.zeros(1), weights) < 0, -weights, weights)
    return lambda places: values(places, weights)


def dpss(n: int, nw: float, k: int) -> np.ndarray:
    """k Slepian tapers (taper, n)."""
    return dpss_at(n, nw, k)(np.arange(n))


# --- spatial ------------------------------------------------------------------


def legendre(n: int, x: np.ndarray) -> np.ndarray:
    a, b = np.ones_like(x), x
    if n == 0:
        return a
    for k in range(2, n + 1):
        a, b = b, ((2 * k - 1) * x * b - (k - 1) * a) / k
    return b


def spline_weights(good: np.ndarray, bad: np.ndarray, terms: int = 4) -> np.ndarray:
    """Spherical-spline weights (bad, good)."""
    unit = lambda p: p / np.where((r := np.sqrt((p**2).sum(axis=1, keepdims=True))) == 0, 1, r)

    def g(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        c = np.clip(unit(a) @ unit(b).T, -1, 1)
        return sum((2 * k + 1) / (k * (k + 1)) ** 2 * legendre(k, c) for k in range(1, terms + 1))

    n = len(good)
    system = np.ones((n + 1, n + 1))
    system[:n, :n] = g(good, good) + 1e-5 * np.eye(n)
    system[n, n] = 0
    right = np.concatenate([g(bad, good), np.ones((len(bad), 1))], axis=1)
    try:
        w = right @ np.linalg.inv(system)[:, :n]
    except np.linalg.LinAlgError:
        w = right @ np.linalg.pinv(system)[:, :n]
    return w if np.isfinite(w).all() else np.full((len(bad), n), 1 / n)


# --- independent components ---------------------------------------------------


def orthogonal(w: np.ndarray) -> np.ndarray:
    u, _, vt = np.linalg.svd(w)
    return u @ vt


def cumulants(moments: np.ndarray) -> np.ndarray:
    """(pair, i, j): fourth-order cumulant matrices of white data for each pair of components k <= m."""
    p = len(moments)
    k, m = np.triu_indices(p)
    eye = np.eye(p)
    pairs = eye[k][:, :, None] * eye[m][:, None, :]
    return moments[:, :, k, m].transpose(2, 0, 1) - (k == m)[:, None, None] * eye - pairs - pairs.transpose(0, 2, 1)


def jade(moments: np.ndarray, tol: float = 1e-6, sweeps: int = 200, angle: str = "optimal") -> np.ndarray:
    """Rotation by Jacobi sweeps over the cumulants; moments E[x_i x_j x_k x_l] of white data.

    The optimal angle of a plane, which leaves the least beside the diagonals of its blocks, is a
    quarter of that of (sum of d^2 - o^2, sum of 2 d o), d being the differences on the diagonals
    and o the sums beside them; so no turn raises the sum of squares beside the diagonals, and
    sweeps end when they turn no more. angle "reference" takes half, as other software does.
    """
    if angle not in ("optimal", "reference"):
        raise ValueError(f"unknown angle {angle!r}")
    share = 4 if angle == "optimal" else 2
    c = cumulants(moments)
    p = len(moments)
    v = np.eye(p)
    planes = list(zip(*np.triu_indices(p, 1)))
    for _ in range(sweeps):
        most = 0.0
        for plane in planes:
            at = list(plane)
            part = c[:, at][:, :, at]
            d, o = part[:, 0, 0] - part[:, 1, 1], part[:, 0, 1] + part[:, 1, 0]
            by = math.atan2(2 * float(d @ o), float(d @ d - o @ o)) / share
            if abs(math.sin(by)) <= tol:
                continue
            turn = np.array([[math.cos(by), -math.sin(by)], [math.sin(by), math.cos(by)]])
            c[:, at, :] = turn.T @ c[:, at, :]
            c[:, :, at] = c[:, :, at] @ turn
            v[:, at] = v[:, at] @ turn
            most = max(most, abs(math.sin(by)))
        if most < tol:
            break
    return v.T


# --- statistics ---------------------------------------------------------------


def _beta_fraction(a: float, b: float, x: float) -> float:
    c, d = 1.0, 1.0 / (1 - (a + b) * x / (a + 1) or 1e-300)
    h = d
    for m in range(1, 400):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / (1 + num * d or 1e-300)
            c = 1 + num / c or 1e-300
            h *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return h


def t_cdf(t: float, df: float) -> float:
    x = df / (df + t * t)
    a, b = df / 2, 0.5
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) if 0 < x < 1 else 0.0
    tail = (front * _beta_fraction(a, b, x) / a if x < (a + 1) / (a + b + 2) else 1 - front * _beta_fraction(b, a, 1 - x) / b) / 2 if t else 0.5
    return 1 - tail if t > 0 else tail


def t_quantile(p: float, df: float) -> float:
    low, high = -1e3, 1e3
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if t_cdf(mid, df) < p else (low, mid)
    return (low + high) / 2


def power_of(matrix: np.ndarray, exponent: float, floor: float = 1e-10) -> np.ndarray:
    values, vectors = np.linalg.eigh((matrix + matrix.T) / 2)
    return (vectors * np.maximum(values, floor) ** exponent) @ vectors.T


def log_of(matrix: np.ndarray, floor: float = 1e-10) -> np.ndarray:
    values, vectors = np.linalg.eigh((matrix + matrix.T) / 2)
    return (vectors * np.log(np.maximum(values, floor))) @ vectors.T


def geometric_mean(covs: np.ndarray, rounds: int = 50, tol: float = 1e-8) -> np.ndarray:
    """Fréchet mean of positive definite matrices."""
    m = covs.mean(axis=0)
    for _ in range(rounds):
        half, back = power_of(m, 0.5), power_of(m, -0.5)
        step = np.mean([log_of(back @ c @ back) for c in covs], axis=0)
        values, vectors = np.linalg.eigh(step)
        m = half @ ((vectors * np.exp(values)) @ vectors.T) @ half
        if np.linalg.norm(step) < tol:
            break
    return m
