"""DataFrame -> DataFrame operators of the forensic analyses."""
