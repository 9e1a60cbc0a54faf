"""Payload encryption: XSalsa20-Poly1305 over chunks, keys from Argon2id, through libsodium where it is installed.

Spark's own aes functions are another cipher. Keys travel as broadcast values or files, never as options, which plans
and logs show.
"""

from __future__ import annotations

import ctypes
import ctypes.util
import os
from functools import lru_cache

from lamina.sources.format import MAC_BYTES, NONCE_BYTES, Crypt, FormatError

KEY_BYTES, SALT_BYTES = 32, 16
CHUNK = 2 << 20
#: Fixed values: (operations, bytes of memory) of the named costs of key derivation.
LIMITS = {"min": (1, 8192), "interactive": (2, 64 << 20), "moderate": (3, 256 << 20), "sensitive": (4, 1 << 30)}
ARGON2ID13 = 2


class CryptographyError(Exception):
    """A key is missing, not wanted, or wrong, or encrypted bytes were altered."""


@lru_cache(maxsize=1)
def sodium():
    for name in (ctypes.util.find_library("sodium"), "libsodium.so.23", "libsodium.so"):
        if name:
            try:
                lib = ctypes.CDLL(name)
            except OSError:
                continue
            if lib.sodium_init() < 0:
                break
            return lib
    raise CryptographyError("libsodium is not installed")


def available() -> bool:
    try:
        return sodium() is not None
    except CryptographyError:
        return False


def random_key() -> bytes:
    return os.urandom(KEY_BYTES)


def derive(passphrase: str | bytes, salt: bytes | None = None, cost: str | tuple[int, int] = "moderate") -> tuple[bytes, tuple[int, int, int, bytes]]:
    """(key, parameters to store) of a passphrase; the salt is 16 bytes, random if none is given."""
    salt = os.urandom(SALT_BYTES) if salt is None else salt
    if not isinstance(salt, bytes) or len(salt) != SALT_BYTES:
        raise ValueError("a salt has 16 bytes")
    ops, mem = LIMITS[cost] if isinstance(cost, str) else cost
    return from_parameters(passphrase, (ops, mem, ARGON2ID13, salt)), (ops, mem, ARGON2ID13, salt)


@lru_cache(maxsize=64)
def from_parameters(passphrase: str | bytes, kdf: tuple[int, int, int, bytes]) -> bytes:
    ops, mem, alg, salt = kdf
    secret = passphrase.encode() if isinstance(passphrase, str) else passphrase
    key = ctypes.create_string_buffer(KEY_BYTES)
    if sodium().crypto_pwhash(key, ctypes.c_ulonglong(KEY_BYTES), secret, ctypes.c_ulonglong(len(secret)), salt, ctypes.c_ulonglong(ops), ctypes.c_size_t(mem), ctypes.c_int(alg)):
        raise CryptographyError("key derivation failed")
    return key.raw


def nonce_after(nonce: bytes, k: int) -> bytes:
    """The k-th nonce after one, as little-endian numbers that wrap."""
    return ((int.from_bytes(nonce, "little") + k) % (1 << 8 * NONCE_BYTES)).to_bytes(NONCE_BYTES, "little")


def seal_chunk(data: bytes, key: bytes, nonce: bytes) -> tuple[bytes, bytes]:
    out, mac = ctypes.create_string_buffer(max(1, len(data))), ctypes.create_string_buffer(MAC_BYTES)
    if sodium().crypto_secretbox_detached(out, mac, data, ctypes.c_ulonglong(len(data)), nonce, key):
        raise CryptographyError("encryption failed")
    return out.raw[: len(data)], mac.raw


def open_chunk(data: bytes, key: bytes, nonce: bytes, mac: bytes) -> bytes:
    out = ctypes.create_string_buffer(max(1, len(data)))
    if sodium().crypto_secretbox_open_detached(out, data, mac, ctypes.c_ulonglong(len(data)), nonce, key):
        raise CryptographyError("decryption failed: wrong key or altered bytes")
    return out.raw[: len(data)]


def sealer(key: bytes, kdf: tuple | None = None, chunk: int = CHUNK, nonce: bytes | None = None):
    """A function that encrypts payloads in chunks under nonces that it uses once."""
    if len(key) != KEY_BYTES:
        raise ValueError("a key has 32 bytes")
    if chunk % 64 or chunk < 1024:
        raise ValueError("chunks are a multiple of 64 bytes, 1024 at least")
    next_nonce = [os.urandom(NONCE_BYTES) if nonce is None else nonce]

    def seal(plain: bytes) -> tuple[bytes, Crypt]:
        first, parts, macs = next_nonce[0], [], []
        for k in range(max(1, -(-len(plain) // chunk))):
            body, mac = seal_chunk(plain[k * chunk : (k + 1) * chunk], key, nonce_after(first, k))
            parts.append(body)
            macs.append(mac)
        next_nonce[0] = nonce_after(first, len(macs))
        return b"".join(parts), Crypt("parallel", chunk, first, macs, kdf)

    return seal


def opened(body: bytes, crypt: Crypt, key: bytes) -> bytes:
    """The plain payload of an encrypted one."""
    if crypt.scheme is None:
        return body
    if crypt.scheme == "sequential":
        return open_chunk(body, key, crypt.nonce, crypt.macs[0])
    size = crypt.chunk_size
    if len(crypt.macs) != max(1, -(-len(body) // size)):
        raise FormatError("as many authentication codes as chunks are needed")
    return b"".join(open_chunk(body[k * size : (k + 1) * size], key, nonce_after(crypt.nonce, k), mac) for k, mac in enumerate(crypt.macs))


def key_for(crypt: Crypt, secret: bytes | str | None) -> bytes:
    """The key of a payload from a raw key or a passphrase; the wrong kind, or none, is an error."""
    if secret is None:
        raise CryptographyError("the archive is encrypted and no key is given")
    if crypt.kdf is None:
        if isinstance(secret, str):
            raise CryptographyError("the archive needs its key, not a passphrase")
        return secret
    if isinstance(secret, bytes) and len(secret) == KEY_BYTES:
        return secret
    return from_parameters(secret, crypt.kdf)
