"""One exception for each way that a build, an open or a lookup can fail."""


class KeyloomError(Exception):
    """Base of all errors of this library."""


class BuilderClosed(KeyloomError): ...


class MixedWriters(KeyloomError): ...


class Cancelled(KeyloomError): ...


class EmptyIndex(KeyloomError): ...


class TooManyKeys(KeyloomError): ...


class KeyTooShort(KeyloomError): ...


class KeyTooLong(KeyloomError): ...


class PayloadOverflow(KeyloomError): ...


class DuplicateKey(KeyloomError): ...


class UnsortedInput(KeyloomError): ...


class KeyCountMismatch(KeyloomError): ...


class PayloadTooLarge(KeyloomError): ...


class FingerprintTooLarge(KeyloomError): ...


class UnknownAlgorithm(KeyloomError): ...


class SplitBucketSeedSearchFailed(KeyloomError): ...


class IndistinguishableHashes(KeyloomError): ...


class BlockOverflow(KeyloomError): ...


class InvalidGeometry(KeyloomError): ...


class InvalidMagic(KeyloomError): ...


class InvalidVersion(KeyloomError): ...


class ChecksumFailed(KeyloomError): ...


class TruncatedFile(KeyloomError): ...


class CorruptedIndex(KeyloomError): ...


class IndexClosed(KeyloomError): ...


class NoPayload(KeyloomError): ...


class NotFound(KeyloomError): ...
