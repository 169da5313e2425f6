"""Uncompressed video in YUV4MPEG2 files: a container that needs no codec library."""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import Any, BinaryIO

import numpy as np

#: By the first letters of a colour space: how many pixels share a colour value across and down; none for grey.
SHARED = {"mono": None, "420": (2, 2), "422": (2, 1), "444": (1, 1), "411": (4, 1)}


class Y4mAdapter:
    """Frames of 8-bit YUV4MPEG2 files: luma, and pictures in RGB. Every frame is a keyframe."""

    def _open(self, f: BinaryIO) -> dict[str, Any]:
        words = f.readline(1024).decode("ascii", "replace").split()
        if not words or words[0] != "YUV4MPEG2":
            raise ValueError("not a YUV4MPEG2 file")
        tags = {w[0]: w[1:] for w in words[1:]}
        rate, seconds = (int(x) for x in tags.get("F", "25:1").split(":"))
        space = tags.get("C", "420jpeg")
        name = next((k for k in SHARED if space.startswith(k)), None)
        if name is None or re.search(r"p\d\d$", space):
            raise ValueError(f"unknown colour space: {space}")
        w, h = int(tags["W"]), int(tags["H"])
        across, down = SHARED[name] or (0, 0)
        chroma = (-(-h // down), -(-w // across)) if across else (0, 0)
        return {"w": w, "h": h, "num": seconds, "den": rate, "space": name, "across": across, "down": down, "chroma": chroma, "size": w * h + 2 * chroma[0] * chroma[1]}

    def _planes(self, path: str) -> Iterator[tuple[dict[str, Any], int, bytes]]:
        with open(path, "rb") as f:
            head = self._open(f)
            n = 0
            while f.readline(1024).startswith(b"FRAME"):
                data = f.read(head["size"])
                if len(data) < head["size"]:
                    return  # cut off
                yield head, n, data
                n += 1

    def frames(self, path: str) -> Iterator[tuple]:
        for head, n, data in self._planes(path):
            yield n, head["num"], head["den"], head["w"], head["h"], data[: head["w"] * head["h"]], True

    def seek(self, path: str, seconds: float) -> Iterator[tuple]:
        """The frames from the last one at or before a time on. Frames whose headers all are the bare word stand at equal distances; others are read from the first on."""
        with open(path, "rb") as f:
            head = self._open(f)
            begin, each = f.tell(), head["size"] + len(b"FRAME\n")
            n = max(0, int(seconds * head["den"] / head["num"])) if head["num"] else 0
            f.seek(0, 2)
            n = max(0, min(n, (f.tell() - begin) // each - 1))
            f.seek(begin + n * each)
            if f.read(6) != b"FRAME\n":
                yield from self.frames(path)
                return
            f.seek(-6, 1)
            while f.readline(1024).startswith(b"FRAME"):
                data = f.read(head["size"])
                if len(data) < head["size"]:
                    return
                yield n, head["num"], head["den"], head["w"], head["h"], data[: head["w"] * head["h"]], True
                n += 1

    def pictures(self, path: str) -> Iterator[tuple[int, int, int, np.ndarray]]:
        """pts, timebase numerator and denominator, and the picture in RGB of each frame."""
        for head, n, data in self._planes(path):
            w, h, (ch, cw) = head["w"], head["h"], head["chroma"]
            y = np.frombuffer(data, np.uint8, w * h).reshape(h, w).astype(float)
            if not head["across"]:
                yield n, head["num"], head["den"], np.repeat(y[:, :, None], 3, 2).astype(np.uint8)
                continue
            u, v = (np.frombuffer(data, np.uint8, ch * cw, w * h + k * ch * cw).reshape(ch, cw).repeat(head["down"], 0).repeat(head["across"], 1)[:h, :w].astype(float) - 128 for k in (0, 1))
            rgb = np.stack([y + 1.402 * v, y - 0.344136 * u - 0.714136 * v, y + 1.772 * u], -1)
            yield n, head["num"], head["den"], np.clip(np.rint(rgb), 0, 255).astype(np.uint8)

    def probe(self, path: str) -> dict[str, Any] | None:
        n = 0
        try:
            with open(path, "rb") as f:
                head = self._open(f)
                while f.readline(1024).startswith(b"FRAME"):
                    if len(f.read(head["size"])) < head["size"]:
                        break
                    n += 1
        except (OSError, ValueError, KeyError):
            return None
        rate = head["den"] / head["num"] if head["num"] else 0.0
        kind = "gray" if head["space"] == "mono" else f"yuv{head['space']}p"
        seconds = int(n / rate) if rate else 0
        return {"video_codec": "rawvideo", "pix_fmt": kind, "profile": "unknown", "level": 0, "width": head["w"], "height": head["h"], "duration": seconds, "avg_frame_rate": rate, "bit_rate": int(head["size"] * 8 * rate) % (1 << 31), "sample_rate_avg": 0}
