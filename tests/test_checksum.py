"""CRC-32C against the plain loop and known values."""

import random
import time

import pytest

from tessera.sources import tfrecord


def plain(data):
    crc = 0xFFFFFFFF
    for byte in data:
        crc = tfrecord._TABLE[(crc ^ byte) & 0xFF] ^ crc >> 8
    return crc ^ 0xFFFFFFFF


def test_known_values():
    assert tfrecord.crc32c(b"123456789") == 0xE3069283 and tfrecord.crc32c(b"") == 0
    assert tfrecord.crc32c(bytes(32)) == 0x8A9136AA and tfrecord.crc32c(b"\xff" * 32) == 0x62A8AB43


@pytest.mark.parametrize("size", [2047, 2048, 2049, 4096, 5000, 8192, 8193, 65_536, 100_003])
def test_lanes_give_what_the_loop_gives(size):
    rng = random.Random(size)
    for data in (rng.randbytes(size), bytes(size), b"\xff" * size, bytes(size - 1) + b"x"):
        assert tfrecord.crc32c(data) == plain(data)


def test_lanes_are_much_faster():
    data = random.Random(1).randbytes(1 << 20)
    tfrecord.crc32c(data)
    took = {}
    for name, run in (("lanes", tfrecord.crc32c), ("loop", plain)):
        began = time.process_time()
        run(data)
        took[name] = time.process_time() - began
    assert took["lanes"] < took["loop"] / 5
