"""Multi-operator compositions: guarded SQL, reports, findings."""
