"""Readers and writers of logs, artifacts, scene folders, manifests and journals."""
