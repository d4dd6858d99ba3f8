"""A smooth-overlap power spectrum in numpy, averaged over the centres of a structure.

The spherical harmonics of two neighbours only ever meet summed over m, which the addition theorem turns into a Legendre
polynomial of the angle between them, so none are evaluated. Radial functions are made orthonormal by quadrature.
"""

from __future__ import annotations

import numpy as np

from ..functions.species import descriptor_width

#: Points of the radial quadrature; a Gaussian's weight at which a neighbour beyond the cutoff stops counting.
POINTS, THRESHOLD = 160, 1e-3


def legendre(x: np.ndarray, l_max: int) -> list[np.ndarray]:
    out = [np.ones_like(x), x]
    for n in range(1, l_max):
        out.append(((2 * n + 1) * x * out[n] - n * out[n - 1]) / (n + 1))
    return out[: l_max + 1]


class PowerSpectrum:
    """Vectors of (numbers, positions, cell, pbc); the entries go by pair of (species, radial function), then by l."""

    def __init__(self, species: tuple[int, ...], r_cut: float = 6.0, n_max: int = 9, l_max: int = 3, sigma: float = 1.0, rbf: str = "gto"):
        self.species, self.r_cut, self.n_max, self.l_max, self.sigma = tuple(sorted(species)), r_cut, n_max, l_max, sigma
        self.reach = r_cut + sigma * np.sqrt(-2 * np.log(THRESHOLD))
        x, w = np.polynomial.legendre.leggauss(POINTS)
        top = self.reach if rbf == "gto" else r_cut
        self.r, self.w = (x + 1) * top / 2, w * top / 2
        self.angles, self.angle_weights = np.polynomial.legendre.leggauss(48)
        self.radial = [self._orthonormal(self._raw(rbf, order)) for order in range(l_max + 1)]
        self.upper = np.triu_indices(len(self.species) * n_max)

    @property
    def width(self) -> int:
        return descriptor_width(len(self.species), self.n_max, self.l_max)

    def _raw(self, rbf: str, order: int) -> np.ndarray:
        if rbf == "polynomial":
            return np.array([(self.r_cut - self.r) ** (n + 2) for n in range(1, self.n_max + 1)])
        at = np.linspace(1, self.r_cut, self.n_max)
        decay = -np.log(THRESHOLD / at**order) / at**2
        return self.r**order * np.exp(-decay[:, None] * self.r**2)

    def _orthonormal(self, g: np.ndarray) -> np.ndarray:
        g = g / np.sqrt((g * g) @ (self.w * self.r**2))[:, None]
        values, vectors = np.linalg.eigh((g * (self.w * self.r**2)) @ g.T)
        return (vectors / np.sqrt(np.maximum(values, 1e-12))) @ vectors.T @ g

    def _neighbours(self, positions: np.ndarray, cell: np.ndarray, pbc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions of all atoms and of their images that some centre can reach, and whose images they are."""
        volume = abs(np.linalg.det(cell))
        ranges = [np.zeros(1, int)] * 3
        if volume > 0:
            spread = np.ptp(positions, axis=0)
            for a in np.flatnonzero(pbc):
                normal = np.cross(cell[(a + 1) % 3], cell[(a + 2) % 3])
                normal = normal / np.linalg.norm(normal)
                n = int(np.ceil((self.reach + np.abs(normal) @ spread) / abs(cell[a] @ normal)))
                ranges[a] = np.arange(-n, n + 1)
        shifts = np.stack(np.meshgrid(*ranges, indexing="ij"), -1).reshape(-1, 3) @ cell
        return (positions[None] + shifts[:, None]).reshape(-1, 3), np.tile(np.arange(len(positions)), len(shifts))

    def _expansion(self, distance: np.ndarray) -> list[np.ndarray]:
        """For each l the overlap of every neighbour's Gaussian with the radial functions, (neighbours, n_max)."""
        gap = self.r[None, :, None] ** 2 + distance[:, None, None] ** 2 - 2 * self.r[None, :, None] * distance[:, None, None] * self.angles
        around = np.exp(-gap / (2 * self.sigma**2)) * self.angle_weights
        out = []
        for order, polynomial in enumerate(legendre(self.angles, self.l_max)):
            out.append((around @ polynomial * 2 * np.pi * self.w * self.r**2) @ self.radial[order].T)
        return out

    def vector(self, numbers, positions, cell, pbc) -> np.ndarray:
        numbers, positions = np.asarray(numbers, int), np.asarray(positions, float).reshape(-1, 3)
        if not len(numbers):
            return np.zeros(self.width)
        images, of = self._neighbours(positions, np.asarray(cell, float).reshape(3, 3), np.asarray(pbc, bool))
        total = np.zeros((len(self.upper[0]), self.l_max + 1))
        for centre in positions:
            apart = images - centre
            distance = np.linalg.norm(apart, axis=1)
            near = distance <= self.reach
            apart, distance, kind = apart[near], distance[near], numbers[of[near]]
            unit = np.divide(apart, distance[:, None], out=np.zeros_like(apart), where=distance[:, None] > 1e-9)
            cosine = unit @ unit.T
            overlaps = self._expansion(distance)
            for order, p in enumerate(legendre(cosine, self.l_max)):
                by_kind = np.concatenate([overlaps[order] * (kind == z)[:, None] for z in self.species], axis=1)
                spectrum = by_kind.T @ p @ by_kind * (2 * order + 1) / (4 * np.pi) * np.pi * np.sqrt(8 / (2 * order + 1))
                total[:, order] += spectrum[self.upper]
        return (total / len(positions)).ravel()
