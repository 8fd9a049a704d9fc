"""Window models in NumPy: a weighted window and a small causal convolution network, with gradients by parameters and by inputs.

A model reads windows (n, days, channels) and gives a logit each. Parameters are one flat vector, so that gradients of
many tasks add up. Everything is deterministic (no dropout), in double precision.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np


def sigmoid(z: np.ndarray) -> np.ndarray:
    e = np.exp(-np.abs(z))
    return np.where(z >= 0, 1.0, e) / (1.0 + e)


@dataclass
class Weighted:
    """logit = bias + sum of weights (days, channels; the last day is the newest) times the window."""

    weights: np.ndarray
    bias: float = 0.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.einsum("nlc,lc->n", x, self.weights) + self.bias

    def input_gradient(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(logits, their gradient by x)."""
        return self.logits(x), np.broadcast_to(self.weights, x.shape)


@dataclass
class Tcn:
    """Residual blocks of causal convolutions with dilations 1, 2, 4, ..., then a hidden layer on the last day.

    A block is relu(relu(convolution) + x), with x through a linear map where the number of channels changes; days before
    the window count as zero. Five levels of three taps see 63 days.
    """

    channels: int
    hidden: int = 16
    levels: int = 5
    taps: int = 3
    theta: np.ndarray = field(default=None, repr=False)

    def __post_init__(self):
        shapes = []
        inputs = self.channels
        for k in range(self.levels):
            shapes += [(f"conv{k}", (self.taps, inputs, self.hidden)), (f"shift{k}", (self.hidden,))]
            if inputs != self.hidden:
                shapes.append((f"skip{k}", (inputs, self.hidden)))
            inputs = self.hidden
        shapes += [("dense", (self.hidden, self.hidden)), ("dense_shift", (self.hidden,)), ("out", (self.hidden,)), ("bias", (1,))]
        self.places, at = {}, 0
        for name, shape in shapes:
            self.places[name] = (at, at + int(np.prod(shape)), shape)
            at += int(np.prod(shape))
        self.size = at
        if self.theta is None:
            self.theta = np.zeros(at)
        assert self.theta.shape == (at,)

    def started(self, seed: int = 0) -> Tcn:
        """The same network with random weights scaled by their inputs; shifts are zero."""
        rng = np.random.default_rng(seed)
        theta = np.zeros(self.size)
        for name, (a, b, shape) in self.places.items():
            if "shift" not in name and name != "bias":
                theta[a:b] = rng.normal(0, np.sqrt(1.0 / np.prod(shape[:-1] or shape)), b - a)
        return self.at(theta)

    def at(self, theta: np.ndarray) -> Tcn:
        return Tcn(self.channels, self.hidden, self.levels, self.taps, np.asarray(theta, float))

    def _of(self, name: str) -> np.ndarray:
        a, b, shape = self.places[name]
        return self.theta[a:b].reshape(shape)

    def _forward(self, x: np.ndarray) -> tuple[np.ndarray, list]:
        kept = []
        for k in range(self.levels):
            w, step = self._of(f"conv{k}"), 2**k
            pad = (self.taps - 1) * step
            padded = np.concatenate([np.zeros((len(x), pad, x.shape[2])), x], axis=1)
            y = sum(padded[:, j * step : j * step + x.shape[1]] @ w[j] for j in range(self.taps)) + self._of(f"shift{k}")
            inner = np.maximum(y, 0)
            total = inner + (x @ self._of(f"skip{k}") if f"skip{k}" in self.places else x)
            kept.append((x, padded, y > 0, total > 0))
            x = np.maximum(total, 0)
        last = x[:, -1]
        h = np.tanh(last @ self._of("dense") + self._of("dense_shift"))
        kept.append((x.shape, last, h))
        return h @ self._of("out") + self._of("bias")[0], kept

    def logits(self, x: np.ndarray) -> np.ndarray:
        return self._forward(np.asarray(x, float))[0]

    def _backward(self, kept: list, d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Gradients by theta (summed over rows) and by x of sum(d * logits)."""
        grad = np.zeros(self.size)

        def put(name: str, value: np.ndarray) -> None:
            a, b, _ = self.places[name]
            grad[a:b] = value.reshape(-1)

        shape, last, h = kept[-1]
        put("bias", np.array([d.sum()]))
        put("out", d @ h)
        dz = np.outer(d, self._of("out")) * (1 - h * h)
        put("dense", last.T @ dz)
        put("dense_shift", dz.sum(0))
        dx = np.zeros(shape)
        dx[:, -1] = dz @ self._of("dense").T
        for k in reversed(range(self.levels)):
            x, padded, on, total_on = kept[k]
            w, step, days = self._of(f"conv{k}"), 2**k, x.shape[1]
            dt = dx * total_on
            dy = dt * on
            put(f"shift{k}", dy.sum((0, 1)))
            put(f"conv{k}", np.stack([np.einsum("nlc,nlh->ch", padded[:, j * step : j * step + days], dy) for j in range(self.taps)]))
            dp = np.zeros_like(padded)
            for j in range(self.taps):
                dp[:, j * step : j * step + days] += dy @ w[j].T
            dx = dp[:, (self.taps - 1) * step :]
            if f"skip{k}" in self.places:
                put(f"skip{k}", np.einsum("nlc,nlh->ch", x, dt))
                dx = dx + dt @ self._of(f"skip{k}").T
            else:
                dx = dx + dt
        return grad, dx

    def input_gradient(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        z, kept = self._forward(np.asarray(x, float))
        return z, self._backward(kept, np.ones(len(z)))[1]

    def loss_gradient(self, x: np.ndarray, y: np.ndarray) -> tuple[float, np.ndarray]:
        """Log loss and its gradient by theta, both summed over rows."""
        z, kept = self._forward(np.asarray(x, float))
        loss = np.logaddexp(0, z) - y * z
        return float(loss.sum()), self._backward(kept, sigmoid(z) - y)[0]
