"""Paged layers: one that fails once per page, one that writes down what it is asked, one that grows."""

import os
import tempfile

#: Workers write here; it is read by the test.
ASKED = os.path.join(tempfile.gettempdir(), "fluvia_fake_layer.log")


class Layer:
    def __init__(self, n: int):
        self.rows, self.failed = [(i, f"name {i}") for i in range(n)], set()

    def count(self, where: str) -> int:
        return len(self.rows)

    def page(self, offset: int, limit: int, where: str):
        if offset not in self.failed:
            self.failed.add(offset)
            return {"error": "busy"}
        return self.rows[offset : offset + limit]


LAYER = Layer(25)


class Logged(Layer):
    """Ignores conditions, as some layers do, but sorts."""

    def page(self, offset, limit, where, order=""):
        with open(ASKED, "a") as f:
            f.write(f"{where} | {order}\n")
        rows = sorted(self.rows, reverse=order.endswith("DESC"))
        return rows[offset : offset + limit]


class Grows(Layer):
    def page(self, offset, limit, where):
        return [(i, f"name {i}") for i in range(27)][offset : offset + limit]


LOGGED, GROWS = Logged(25), Grows(25)
