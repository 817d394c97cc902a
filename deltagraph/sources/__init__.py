"""Readers, writers, generators and graph builders."""
