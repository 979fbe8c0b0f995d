"""A model that workers import by name."""

from tests.responses import TAX


class Echo:
    """Answers with what the video's name asks for."""

    def prepare(self, video):
        if "broken" in video:
            raise OSError("cannot open")
        return video

    def generate(self, requests):
        keys = ", ".join(f'"{TAX.output_key(i)}": {"true" if i == "C2" else "false"}' for i in TAX.ids)
        return [RuntimeError("no memory") if "fail" in r else None if "none" in r else "words" if "words" in r else f'"{TAX.output_key("C1")}": false' if "part" in r else keys for r in requests]


class Batch:
    """Fails on whole batches, and alone on one video."""

    def prepare(self, video):
        return video

    def generate(self, requests):
        if len(requests) > 1:
            raise MemoryError("too many")
        return [ValueError("bad") if requests[0] == "v2" else f"BLOCK {requests[0]}"]
