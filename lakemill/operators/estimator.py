"""What the models share: parameters by name."""

from __future__ import annotations

import inspect


class Estimator:
    @classmethod
    def _names(cls) -> list[str]:
        return [p for p in inspect.signature(cls.__init__).parameters if p != "self"]

    def get_params(self) -> dict:
        return {p: getattr(self, p) for p in self._names()}

    def set_params(self, **params) -> Estimator:
        if unknown := [p for p in params if p not in self._names()]:
            raise ValueError(f"unknown parameters: {unknown}")
        for p, v in params.items():
            setattr(self, p, v)
        return self

    def describe(self) -> str:
        return f"{type(self).__name__}({', '.join(f'{p}={v!r}' for p, v in self.get_params().items())})"
