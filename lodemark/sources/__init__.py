"""Readers of images, annotations, splits and manifests, and writers of manifests and reports."""
