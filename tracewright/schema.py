"""Columns, aliases and the fixed values that results depend on."""

from __future__ import annotations

import re

from pyspark.sql import types as T

# The canonical columns, in order; all are strings.
CANONICAL = [
    "RecordID", "TimeCreated", "EventID", "Level", "LevelName", "Channel", "Provider", "ProviderGuid",
    "EventSourceName", "Task", "Opcode", "Keywords", "Computer", "UserID", "ProcessID", "ThreadID",
    "Version", "ActivityID", "RelatedActivityID", "Qualifiers", "EventData", "UserData", "Message",
]
CANONICAL_SCHEMA = T.StructType([T.StructField(c, T.StringType()) for c in CANONICAL])

# Names of the levels 0 to 5.
LEVEL_NAMES = {0: "LogAlways", 1: "Critical", 2: "Error", 3: "Warning", 4: "Information", 5: "Verbose"}
# Rank of a level when templates are rolled up; unknown names rank as Information.
LEVEL_RANK = {"Critical": 4, "Error": 3, "Warning": 2, "Information": 1, "Verbose": 0}
# Level spellings that a level filter accepts.
LEVEL_FORMS = {
    "critical": ["1", "critical"],
    "error": ["2", "error", "failure", "audit failure"],
    "warning": ["3", "warning"],
    "information": ["4", "0", "information", "informational", "info", "audit success", "logalways"],
    "verbose": ["5", "verbose"],
}

# Words that stand for no value, at conversion and in preprocessing.
NULL_WORDS = ["null", "none", "nan"]
NULL_WORDS_WIDE = ["", "null", "none", "nan", "n/a", "na", "<na>", "undefined"]

# Payload keys of each logical field, with those of single event ids.
PAYLOAD_KEYS = {
    "ip_address": {"": ["IpAddress", "SourceAddress", "ClientAddress", "SourceIP", "ClientIP", "IPAddress"], "4624": ["IpAddress"], "4625": ["IpAddress"]},
    "logon_id": {"": ["TargetLogonId", "SubjectLogonId", "LogonId"], "4624": ["TargetLogonId", "SubjectLogonId"], "4625": ["TargetLogonId", "SubjectLogonId"]},
    "user_id": {
        "": ["TargetUserName", "SubjectUserName", "UserName", "AccountName", "TargetUser", "SubjectUserSid", "TargetUserSid", "UserSid"],
        "4624": ["TargetUserName", "SubjectUserName", "TargetUserSid", "SubjectUserSid"],
        "4625": ["TargetUserName", "SubjectUserName", "TargetUserSid", "SubjectUserSid"],
    },
    "user_name": {"": ["TargetUserName", "SubjectUserName", "UserName", "AccountName"], "4624": ["TargetUserName", "SubjectUserName"], "4625": ["TargetUserName", "SubjectUserName"]},
    "process_name": {"": ["ProcessName", "NewProcessName", "Image", "Application"], "4688": ["NewProcessName", "ParentProcessName"]},
    "process_id": {"": ["ProcessId", "NewProcessId", "ProcessID"], "4688": ["NewProcessId", "ProcessId"]},
    "status_code": {"": ["Status", "SubStatus", "ErrorCode", "StatusCode"], "4625": ["Status", "SubStatus"]},
    "computer": {"": ["WorkstationName", "TargetServerName", "ComputerName"], "4624": ["WorkstationName", "TargetServerName"]},
}
# Well-known accounts and the spellings that count as the same.
ACCOUNT_FORMS = {
    "system": ["s-1-5-18", "system"],
    "local system": ["s-1-5-18", "system", "local system"],
    "local service": ["s-1-5-19", "local service"],
    "network service": ["s-1-5-20", "network service"],
    "s-1-5-18": ["s-1-5-18", "system"],
    "s-1-5-19": ["s-1-5-19", "local service"],
    "s-1-5-20": ["s-1-5-20", "network service"],
}

# Short names of event families.
EVENT_FAMILIES = {
    "4624": "Successful Logon", "4625": "Failed Logon", "4634": "Account Logoff", "4647": "User-Initiated Logoff",
    "4648": "Logon with Explicit Credentials", "4672": "Special Privileges Assigned to New Logon",
    "4776": "Domain Controller Validated Credentials (NTLM)", "4768": "Kerberos Authentication Ticket (TGT) Requested",
    "4769": "Kerberos Service Ticket Requested", "4771": "Kerberos Pre-Authentication Failed",
    "4688": "A New Process Was Created", "4689": "A Process Has Exited", "4697": "A Service Was Installed in the System",
    "4698": "A Scheduled Task Was Created", "4699": "A Scheduled Task Was Deleted", "4700": "A Scheduled Task Was Enabled",
    "4702": "A Scheduled Task Was Updated", "4720": "A User Account Was Created", "4722": "A User Account Was Enabled",
    "4724": "An Attempt Was Made to Reset an Account Password", "4726": "A User Account Was Deleted",
    "4738": "A User Account Was Modified", "4740": "A User Account Was Locked Out",
    "4728": "A Member Was Added to a Security-Enabled Global Group", "4732": "A Member Was Added to a Security-Enabled Local Group",
    "4756": "A Member Was Added to a Security-Enabled Universal Group", "1102": "The Audit Log Was Cleared",
    "4719": "System Audit Policy Was Changed", "7036": "Service State Changed", "7040": "Service Start Type Changed",
    "7045": "A New Service Was Installed on the System", "1074": "System Shutdown or Restart Initiated",
    "6005": "Event Log Service Started", "6006": "Event Log Service Stopped",
    "6008": "The Previous System Shutdown Was Unexpected", "1000": "Application Error (Crash)",
    "1001": "Windows Error Reporting (WER)", "1002": "Application Hang",
}

# One-line descriptions of event ids.
EVENT_DESCRIPTIONS = {
    "4624": "Successful account logon", "4625": "Failed account logon / Authentication failure", "4634": "Account logoff",
    "4648": "Logon attempted using explicit credentials", "4672": "Special privileges assigned to new logon",
    "4688": "New process creation", "4689": "Process exit / termination", "4720": "User account created",
    "4724": "Password reset attempted", "4740": "User account locked out", "1102": "Audit log cleared",
    "7036": "Service state change (started/stopped)", "7040": "Service start type changed", "7045": "New Windows service installed",
    "6008": "Unexpected dirty shutdown", "1000": "Application crash / faulting module error", "10016": "DCOM permission error",
    "7": "Disk bad block / I/O device error", "5": "Disk block warning", "16": "Filesystem data integrity verification warning",
    "12": "Operating system kernel startup time", "13": "Operating system kernel shutdown", "41": "System rebooted without cleanly shutting down",
}

# Time window in seconds, label and weight of a link through each entity type.
LINK_RULES = {
    "logon_id": (43200, "High", 1.0),
    "activity_id": (43200, "High", 1.0),
    "user_id": (14400, "Medium-high", 0.8),
    "ip_address": (3600, "Medium", 0.6),
    "process_id_disambiguated": (43200, "High", 1.0),
    "process_id": (300, "Low", 0.3),
    "thread_id": (300, "Low", 0.2),
    "computer": (86400, "Trivial", 0.1),
}
#: For entity types without a rule.
LINK_DEFAULT = (3600, "Medium", 0.5)

# Masks of variable parts, in the order in which they are applied.
MASKS = [
    (r"\b0x[0-9a-fA-F]+\b", "<HEX>"),
    (r"\b(?:\d{1,3}\.){3}\d{1,3}(?::\d{1,5})?\b", "<IP>"),
    (r"\bS-1-[0-59]-\d+(?:-\d+)+\b", "<SID>"),
    (r"\{?[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}\}?", "<GUID>"),
    (r"[a-zA-Z]:\\(?:[^\\/:*?\"<>|\r\n]+\\)*[^\\/:*?\"<>|\r\n]*", "<PATH>"),
    (r"\b\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}(?:\.\d+)?Z?\b", "<TIME>"),
]

# Logical name -> spellings of a column (compared without ``_``, ``-``, ``.``, blanks and case), best first.
ALIASES = {
    "record_id": ["RecordID", "EventRecordID", "event_record_id"],
    "time": ["TimeCreated", "time_created_utc", "SystemTime", "timestamp"],
    "event_id": ["EventID", "Id", "event_code"],
    "level": ["LevelName", "Level", "severity"],
    "channel": ["Channel", "source_type", "LogName", "Source"],
    "provider": ["Provider", "ProviderName", "SourceName"],
    "computer": ["Computer", "Hostname", "Host", "MachineName"],
    "user_id": ["UserID", "SecurityUserID", "TargetUserName", "User"],
    "process_id": ["ProcessID", "pid"],
    "thread_id": ["ThreadID", "tid"],
    "event_data": ["EventData", "Payload"],
    "user_data": ["UserData"],
    "message": ["Message", "Details"],
    "raw_xml": ["RawXML"],
}


def squeeze(name: str) -> str:
    return re.sub(r"[_\s\-.]+", "", name).lower()


def resolve_columns(columns: list[str], custom: dict[str, str] | None = None) -> dict[str, str]:
    """Logical name -> actual column. Each column serves one name; ``custom`` goes first."""
    by_form: dict[str, str] = {}
    for c in columns:
        by_form.setdefault(squeeze(c), c)
    out: dict[str, str] = {}
    for name, column in (custom or {}).items():
        if squeeze(column) in by_form:
            out[name] = by_form[squeeze(column)]
    for name, forms in ALIASES.items():
        if name in out:
            continue
        for f in forms:
            c = by_form.get(squeeze(f))
            if c is not None and c not in out.values():
                out[name] = c
                break
    return out
