"""A gated recurrent layer in numpy, forward and backward, and the Adam rule.

Lanes are columns, so that each gate lies in one piece. The inputs come projected: x has, for each lane, what the
inputs add to the update gate, the reset gate and the candidate. With u the recurrent weights (hidden, 3 hidden):
z = s(x_z + h u_z), r = s(x_r + h u_r), n = tanh(x_n + r (h u_n)), h' = n + z (h - n).
"""

from __future__ import annotations

import numpy as np


def sigmoid(x: np.ndarray) -> np.ndarray:
    """1 / (1 + exp(-x)), in the place of x. Below -88 the exponential is infinite and the result is 0, as it should be."""
    np.negative(x, out=x)
    with np.errstate(over="ignore"):
        np.exp(x, out=x)
    x += 1
    return np.reciprocal(x, out=x)


def tanh(x: np.ndarray) -> np.ndarray:
    """The hyperbolic tangent in the place of x, as 2 s(2x) - 1: numpy's exponential is the faster of the two."""
    x *= 2
    sigmoid(x)
    x *= 2
    x -= 1
    return x


def step(x: np.ndarray, h: np.ndarray, u: np.ndarray, keep: list | None = None) -> np.ndarray:
    """The next states (hidden, lanes); x (3 hidden, lanes) is overwritten. keep gets what the way back needs."""
    k = len(h)
    a = u.T @ h
    gates, n, an = x[: 2 * k], x[2 * k :], a[2 * k :]
    gates += a[: 2 * k]
    sigmoid(gates)
    z, r = gates[:k], gates[k:]
    n += r * an
    tanh(n)
    out = h - n
    out *= z
    out += n
    if keep is not None:
        keep.append((h, z, r, n, an))
    return out


def back(kept: tuple, dh: np.ndarray, u: np.ndarray, du: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradients of a step's projected inputs and of the states before it; du is added to."""
    h, z, r, n, an = kept
    k = len(h)
    dx = np.empty((3 * k, h.shape[1]), h.dtype)
    dz, dr, dn = dx[:k], dx[k : 2 * k], dx[2 * k :]
    before = dh * z
    np.subtract(dh, before, out=dn)  # dh (1 - z)
    np.subtract(h, n, out=dz)
    dz *= z
    dz *= dn
    square = n * n
    square *= dn
    dn -= square
    np.multiply(dn, an, out=dr)
    dr *= r
    dr -= dr * r
    da = dx.copy()
    da[2 * k :] *= r
    du += h @ da.T
    before += u @ da
    return dx, before


def summed_by(index: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    """The sum of the rows of each index below n."""
    out = np.zeros((n, rows.shape[1]), np.float32)
    if len(index):
        order = np.argsort(index.astype(np.uint16) if n <= 1 << 16 else index, kind="stable")
        s = index[order]
        first = np.flatnonzero(np.concatenate(([True], s[1:] != s[:-1])))
        out[s[first]] = np.add.reduceat(rows.take(order, axis=0), first, axis=0)
    return out


class Adam:
    def __init__(self, params: dict[str, np.ndarray], rate: float):
        self.params, self.rate, self.t = params, rate, 0
        self.m = {k: np.zeros_like(v) for k, v in params.items()}
        self.v = {k: np.zeros_like(v) for k, v in params.items()}

    def update(self, grads: dict[str, np.ndarray], clip: float = 5.0, scale: float = 1.0) -> None:
        """A step along the gradients times scale, shortened to a norm of clip. The gradients are overwritten."""
        norm = scale * float(np.sqrt(sum(float(np.vdot(g, g)) for g in grads.values())))
        scale *= min(1.0, clip / (norm + 1e-12))
        self.t += 1
        rate = self.rate * np.sqrt(1 - 0.999**self.t) / (1 - 0.9**self.t)
        for k, g in grads.items():
            m, v = self.m[k], self.v[k]
            g *= np.float32(scale)
            m *= np.float32(0.9)
            m += np.float32(0.1) * g
            g *= g
            g -= v
            g *= np.float32(0.001)
            v += g
            np.sqrt(v, out=g)
            g += np.float32(1e-8)
            np.divide(m, g, out=g)
            g *= np.float32(rate)
            self.params[k] -= g
