"""triagelake: document-triage analytics expressed as Spark DataFrame plans."""
