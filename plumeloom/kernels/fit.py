"""Fitting gas concentrations and polynomial baselines to observed transmittances, many at once."""

from __future__ import annotations

import numpy as np

ORDER = 6
#: Numbers that one array holds while many spectra are fitted.
AT_ONCE = 1 << 18


class Transmittances:
    """Per band, with extra gas over that without, averaged over a band's samples, for many paths.

    Bands of fewer samples are filled up with ones of no response.
    """

    def __init__(self, response: list[np.ndarray], standard: list[np.ndarray], gas_by_standard: list[np.ndarray]):
        n, self.width = len(response), max(map(len, response), default=0)
        table = [np.full((n, self.width), fill) for fill in (0.0, 1.0, 1.0)]
        for into, bands in zip(table, (response, standard, gas_by_standard), strict=True):
            for k, of in enumerate(bands):
                into[k, : len(of)] = of
        self.response, self.standard, q = table
        self.gas = np.log(np.maximum(q, 1e-300))

    def along(self, path: np.ndarray):
        """A function from concentrations (and which of the paths they are for) to transmittances and their slopes."""
        base = self.response * self.standard ** path[:, None, None]
        base = base / (base.sum(axis=2, keepdims=True) + 1e-20)

        def at(conc: np.ndarray, of=slice(None)) -> tuple[np.ndarray, np.ndarray]:
            rate = self.gas * path[of, None, None]
            parts = base[of] * np.exp(rate * conc[:, None, None])
            return parts.sum(axis=2), (parts * rate).sum(axis=2)

        return at


def transmittance_of(response: list[np.ndarray], standard: list[np.ndarray], gas_by_standard: list[np.ndarray]):
    """From a path to a function from a concentration to transmittance per band."""
    table = Transmittances(response, standard, gas_by_standard)

    def at(path: float):
        many = table.along(np.array([path], float))
        return lambda conc: many(np.array([conc], float))[0][0]

    return at


def fitted(wavelengths: np.ndarray, observed: np.ndarray, transmittance, order: int = ORDER, turns: int = 200):
    """(conc, coefficients) of one spectrum, as fitted_many() has them; None where it is not finite or too short."""

    def at(conc: np.ndarray, of=slice(None)):
        step = 1e-6 * np.maximum(1.0, np.abs(conc))
        gas = np.array([transmittance(c) for c in conc])
        return gas, (np.array([transmittance(c) for c in conc + step]) - gas) / step[:, None]

    conc, coefficients = fitted_many(wavelengths, np.asarray(observed, float)[None], at, order, turns)
    return None if np.isnan(conc[0]) else (conc[0], coefficients[0])


def fitted_many(wavelengths: np.ndarray, observed: np.ndarray, transmittance, order: int = ORDER, turns: int = 200) -> tuple[np.ndarray, np.ndarray]:
    """conc and coefficients that minimise, of each row of observed, the sum of soft L1 of (polynomial * gas - observed).

    transmittance: as of Transmittances.along(). Concentrations are at least 0. Levenberg-Marquardt steps on the reweighted
    residuals, with the bound kept by projection, of all rows that have not ended; NaN where a row is not finite.
    """
    n, bands = observed.shape
    conc, out = np.full(n, np.nan), np.full((n, order + 1), np.nan)
    todo = np.flatnonzero(np.isfinite(observed).all(axis=1))
    if bands <= order or not len(todo):
        return conc, out
    x = (wavelengths - wavelengths.mean()) / (wavelengths.std() or 1.0)
    basis, back = np.linalg.qr(np.vander(x, order + 1, increasing=True))
    squares = np.einsum("bi,bj->bij", basis, basis).reshape(bands, -1)
    loss_of = lambda r: np.sum(2 * (np.sqrt(1 + r * r) - 1), axis=1)

    y = observed[todo]
    p = np.column_stack([np.ones(len(todo)), y @ basis])
    gas, slope = transmittance(p[:, 0], todo)
    r = p[:, 1:] @ basis.T * gas - y
    loss, damp = loss_of(r), np.full(len(todo), 1e-3)
    taken, refused = np.zeros(len(todo), int), np.zeros(len(todo), int)
    size, at = order + 2, np.arange(order + 2)
    while len(todo):
        w = 1 / np.sqrt(1 + r * r)
        to_conc = p[:, 1:] @ basis.T * slope
        grad, hess = np.empty((len(todo), size)), np.empty((len(todo), size, size))
        grad[:, 0], grad[:, 1:] = (w * r * to_conc).sum(axis=1), (w * r * gas) @ basis
        hess[:, 0, 0] = (w * to_conc * to_conc).sum(axis=1)
        hess[:, 0, 1:] = hess[:, 1:, 0] = (w * to_conc * gas) @ basis
        hess[:, 1:, 1:] = ((w * gas * gas) @ squares).reshape(-1, order + 1, order + 1)
        held = (p[:, 0] <= 0) & (grad[:, 0] > 0)
        hess[held, 0, :], hess[held, :, 0], hess[held, 0, 0], grad[held, 0] = 0.0, 0.0, 1.0, 0.0
        hess[:, at, at] += damp[:, None] * (hess[:, at, at] + 1e-12)
        try:
            move = np.linalg.solve(hess, -grad[..., None])[..., 0]
        except np.linalg.LinAlgError:
            move = (np.linalg.pinv(hess, hermitian=True) @ -grad[..., None])[..., 0]
        trial = p + move
        trial[:, 0] = np.maximum(0.0, trial[:, 0])
        gas2, slope2 = transmittance(trial[:, 0], todo)
        r2 = trial[:, 1:] @ basis.T * gas2 - y
        loss2 = loss_of(r2)
        good = np.isfinite(loss2) & (loss2 <= loss)
        small = np.abs(move).max(axis=1) < 1e-9
        ended = np.where(good, small & (loss - loss2 <= 1e-15 * (1 + loss2)), small)
        taken, refused = taken + good, np.where(good, 0, refused + 1)
        damp = np.where(good, np.maximum(damp / 10, 1e-12), damp * 10)
        p, r, gas, slope = (np.where(good[:, None], b, a) for a, b in ((p, trial), (r, r2), (gas, gas2), (slope, slope2)))
        loss = np.where(good, loss2, loss)
        ended |= (taken >= turns) | (refused >= 30)
        if ended.any():
            conc[todo[ended]], out[todo[ended]] = p[ended, 0], p[ended, 1:]
            todo, y, p, r, gas, slope, loss, damp, taken, refused = (v[~ended] for v in (todo, y, p, r, gas, slope, loss, damp, taken, refused))
    return conc, np.linalg.solve(back, out.T).T
