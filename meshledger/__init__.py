"""Network usage and prepaid ledger analytics as Spark DataFrame operators."""

from meshledger.study import StudyWindow

__all__ = ["StudyWindow"]
