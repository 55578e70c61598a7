"""Spectral elements: nodes and weights, Lagrange bases, hexahedra with 27 anchors and their inverse map."""

from __future__ import annotations

from functools import lru_cache

import numpy as np


@lru_cache(16)
def nodes_and_weights(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Gauss-Lobatto-Legendre nodes on [-1, 1], both ends among them, and their weights."""
    top = np.polynomial.legendre.Legendre.basis(n - 1)
    x = np.concatenate([[-1.0], np.sort(top.deriv().roots().real), [1.0]])
    x = (x - x[::-1]) / 2  # symmetric to the last bit
    return x, 2 / (n * (n - 1) * top(x) ** 2)


def lagrange(x: np.ndarray, nodes: np.ndarray) -> np.ndarray:
    """Values of the Lagrange polynomials of the nodes at x: shape of x, then nodes."""
    x = np.asarray(x, float)[..., None]
    out = np.ones(x.shape[:-1] + (len(nodes),))
    for m, at in enumerate(nodes):
        other = np.arange(len(nodes)) != m
        out[..., other] *= (x - at) / (nodes[other] - at)
    return out


@lru_cache(16)
def derivative_matrix(n: int) -> np.ndarray:
    """D[i, j]: slope of the j-th Lagrange polynomial at the i-th node."""
    x, _ = nodes_and_weights(n)
    gaps = x[:, None] - x + np.eye(n)
    c = gaps.prod(axis=1)
    d = c[:, None] / c / gaps
    np.fill_diagonal(d, 0)
    np.fill_diagonal(d, -d.sum(axis=1))
    return d


def linear(x: np.ndarray, nodes: np.ndarray) -> np.ndarray:
    """Weights of linear interpolation between the nodes around x, clamped at the ends."""
    x = np.clip(np.asarray(x, float), nodes[0], nodes[-1])
    i = np.clip(np.searchsorted(nodes, x, "right") - 1, 0, len(nodes) - 2)
    share = (x - nodes[i]) / (nodes[i + 1] - nodes[i])
    out = np.zeros(x.shape + (len(nodes),))
    np.put_along_axis(out, i[..., None], (1 - share)[..., None], -1)
    np.put_along_axis(out, i[..., None] + 1, share[..., None], -1)
    return out


ANCHORS = np.array([-1.0, 0.0, 1.0])


def quadratic(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The three quadratic shape functions at x, and their slopes."""
    return np.stack([x * (x - 1) / 2, 1 - x * x, x * (x + 1) / 2], -1), np.stack([x - 0.5, -2 * x, x + 0.5], -1)


def hexahedron(local: np.ndarray, anchors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places (rows x 3) and Jacobians (rows x 3 x 3, place by local) of local coordinates in elements
    of 27 anchors (rows x 27 x 3, first coordinate fastest)."""
    (a, da), (b, db), (c, dc) = (quadratic(local[:, i]) for i in range(3))
    grid = anchors.reshape(-1, 3, 3, 3, 3)  # third, second, first, place
    at = lambda u, v, w: np.einsum("rk,rj,ri,rkjix->rx", w, v, u, grid)
    return at(a, b, c), np.stack([at(da, b, c), at(a, db, c), at(a, b, dc)], -1)


def locate(places: np.ndarray, anchors: np.ndarray, steps: int = 5) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Local coordinates by Newton steps from the centre, whether the place is inside, and how far the
    place of the coordinates, clamped to the element, is from it."""
    local = np.zeros((len(places), 3))
    for _ in range(steps):
        x, jacobian = hexahedron(local, anchors)
        with np.errstate(all="ignore"):
            local = np.clip(local + np.einsum("rij,rj->ri", np.linalg.pinv(jacobian), places - x), -2, 2)
    inside = (np.abs(local) <= 1 + 1e-9).all(axis=1)
    local = np.clip(local, -1, 1)
    return local, inside, np.sqrt(((hexahedron(local, anchors)[0] - places) ** 2).sum(axis=1))
