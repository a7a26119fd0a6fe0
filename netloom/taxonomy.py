"""Two-level label taxonomy: 34 specific labels under 8 macro classes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The label names are part of the data format.
LABELS_BY_MACRO = {
    "DDoS": (
        "DDoS-ICMP_Flood", "DDoS-UDP_Flood", "DDoS-TCP_Flood", "DDoS-PSHACK_Flood",
        "DDoS-RSTFINFlood", "DDoS-SYN_Flood", "DDoS-SynonymousIP_Flood",
        "DDoS-ICMP_Fragmentation", "DDoS-UDP_Fragmentation", "DDoS-ACK_Fragmentation",
        "DDoS-HTTP_Flood", "DDoS-SlowLoris",
    ),
    "DoS": ("DoS-UDP_Flood", "DoS-TCP_Flood", "DoS-SYN_Flood", "DoS-HTTP_Flood"),
    "Mirai": ("Mirai-greeth_flood", "Mirai-udpplain", "Mirai-greip_flood"),
    "Spoofing": ("MITM-ArpSpoofing", "DNS_Spoofing"),
    "Recon": (
        "Recon-HostDiscovery", "Recon-OSScan", "Recon-PortScan", "Recon-PingSweep",
        "VulnerabilityScan",
    ),
    "Web": (
        "SqlInjection", "XSS", "CommandInjection", "Uploading_Attack",
        "BrowserHijacking", "Backdoor_Malware",
    ),
    "BruteForce": ("DictionaryBruteForce",),
    "Benign": ("BenignTraffic",),
}
BENIGN_LABEL = "BenignTraffic"
BENIGN_MACRO = "Benign"

MACRO_NAMES = sorted(LABELS_BY_MACRO)
MACRO_CODE = {name: code for code, name in enumerate(MACRO_NAMES)}


def taxonomy(spark: SparkSession) -> DataFrame:
    """label, macro, macro_code: 34 rows, so callers may always broadcast it."""
    rows = [(label, macro, MACRO_CODE[macro])
            for macro, labels in LABELS_BY_MACRO.items() for label in labels]
    return spark.createDataFrame(rows, "label string, macro string, macro_code int")


def macro_name(code: Column) -> Column:
    """Class name of a macro code; ``Class_<i>`` for a code outside the range."""
    names = F.array(*[F.lit(n) for n in MACRO_NAMES])
    known = code.between(0, len(MACRO_NAMES) - 1)
    return F.when(known, F.element_at(names, code.cast("int") + 1)).otherwise(
        F.concat(F.lit("Class_"), code.cast("string")))
