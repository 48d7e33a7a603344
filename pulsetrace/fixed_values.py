"""Lists and names that results depend on."""

# Malicious destination addresses for connection rows.
CONN_INDICATORS = (
    "172.93.179.196", "52.18.235.51", "217.79.243.147", "194.37.97.139", "179.60.146.16",
    "23.82.141.136", "179.60.150.125", "108.177.235.172", "172.93.201.12", "23.106.215.100",
    "172.241.27.237", "139.60.161.45", "139.60.160.8", "5.149.249.187", "103.207.42.11",
    "78.128.112.139", "45.147.230.242", "213.227.154.169", "23.106.215.64", "64.44.135.171",
    "185.173.34.75", "108.62.118.133", "172.93.193.21", "194.135.24.240", "185.217.1.23",
    "190.123.44.220", "172.93.181.105", "23.82.141.226", "23.106.215.123", "23.82.141.117",
    "172.93.201.141", "172.241.29.144", "144.202.49.189",
)

# The four connection-row addresses that session-group rows do not use.
CONN_ONLY_INDICATORS = ("217.79.243.147", "194.37.97.139", "179.60.146.16", "144.202.49.189")

GROUP_INDICATORS = tuple(ip for ip in CONN_INDICATORS if ip not in CONN_ONLY_INDICATORS)

# Capture names (file name up to its first dot) that hold benign traffic only.
CONN_BENIGN_CAPTURES = ("cicids17-normal", "ctu-normal-20")
GROUP_BENIGN_CAPTURES = ("cicids17", "ctu-normal-20")

# Services kept on malicious training rows.
BEACON_SERVICES = ("http", "ssl")

# Display names of the two classes.
CLASS_NAMES = {0: "Legitimate", 1: "Cobalt Strike Beacon"}

# Field texts that pandas.read_csv takes as missing by default.
NA_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)
