"""pulselake.functions"""
