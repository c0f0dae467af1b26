"""Role tables of a retail bank, derived from the driver's star schema and event table.

Real deployments read their own tables in these shapes; here every role is a view over the given
parquet tables. The text is the common subset of Spark SQL and DuckDB, so tests can build the same
inputs on both sides (``role_sql``). Names in braces are parquet tables. Fact roles keep every row
of their table; a few lookups lack an entry so that left joins have something to miss.
"""

from __future__ import annotations

import re
from functools import lru_cache

from pyspark.sql import DataFrame, functions as F

from clientlens.plans.devices import APP_CATEGORIES
from clientlens.sources.readers import Tables

# events happened in January 2024: campaign contacts are placed in January 1997, installs in
# January 1995, so that they meet the orders and customers of the star schema
CONTACT_SHIFT_DAYS = 9861
INSTALL_SHIFT_DAYS = 10592

CREATED = ("(TIMESTAMP_NTZ '1995-01-01 08:00:00' + interval '1' day * ({k} % 1461)"
           " + interval '1' minute * ({k} % 600))")

# raw install sources, one per k modulo their number; they cover every channel rule
RAW_SOURCES = (
    "Social_page", "af_app_invites", "Refer_a_friend", "moengage_push", "Apple Search Ads", "Facebook Ads",
    "meta_ads", "facebook", "Restricted", "googleadwords_int", "bytedanceglobal_int", "pokkt_x", "Bank_CPA",
    "campaign_name_1", "tyrads_int", "SalesDoubler", "imoney_ph", "moneymax_ph", "jeff_app", "shareit_int",
    "appnext_int", "MediaDonuts", "Entravision", "shopback_int", "deepsea", "avow_int", "vivo_int", "SevenEleven_store",
    "af_banner", "sendgrid_mail", "Website", "PRFlexLoans_WebAndroidPressRelease", "invalid_media_source_name", "None",
    "Email", "Partnership", "unlisted_source",
)

ROLE_SQL = {
    "customers": f"""
        SELECT cast(c_custkey as string) AS cust_id, c_custkey AS cust_key,
               'U' || cast(c_custkey as string) AS user_id,
               'D' || cast(c_custkey - c_custkey % 2 as string) AS device_id,
               {CREATED.format(k='c_custkey')} AS created_dt,
               CASE WHEN c_acctbal < 0 THEN 'BKYC' WHEN c_acctbal < 100 THEN NULL ELSE 'SKYC' END AS kyc_status,
               CASE c_mktsegment WHEN 'BUILDING' THEN 'LOAN1.0' WHEN 'AUTOMOBILE' THEN 'TSA1.0'
                    WHEN 'MACHINERY' THEN 'TSAE1.0' ELSE c_mktsegment END AS product,
               CASE WHEN c_nationkey % 2 = 0 THEN 'F' ELSE 'M' END AS gender,
               '63' || cast(905 + c_nationkey as string) || lpad(cast(c_custkey as string), 7, '0') AS mobile_no,
               'NATION_' || cast(c_nationkey as string) AS birthplace
        FROM {{customer}}""",
    "transactions": """
        SELECT cast(o_orderkey as string) AS transaction_id, cast(o_custkey as string) AS customer_id,
               '608' || cast(o_orderkey as string) AS accountid,
               cast(o_orderdate as date) AS transaction_date,
               split_part('N01|IP2|XE2|00T|21C|P01|A01|BP1|BP2', '|', cast(1 + o_orderkey % 9 as int)) AS transaction_code,
               CASE WHEN o_orderstatus = 'P' AND o_orderpriority = '5-LOW' THEN 'Pending' ELSE 'Success' END AS status,
               CASE o_orderpriority WHEN '1-URGENT' THEN 'Billspay' WHEN '2-HIGH' THEN 'Core transactions'
                    WHEN '3-MEDIUM' THEN 'Instapay' WHEN '4-NOT SPECIFIED' THEN 'Pesonet' ELSE 'Core transactions' END AS channel,
               CASE WHEN o_orderstatus = 'F' THEN 'CREDIT' ELSE 'DEBIT' END AS credit_debit_indicator,
               CASE WHEN o_orderkey % 7 < 4 THEN 'Outside Bank' ELSE 'Inside Bank' END AS inter_exter_flag,
               CASE WHEN o_orderkey % 20 < 15 THEN 'Bank Account' WHEN o_orderkey % 20 = 15 THEN 'Individual Stash'
                    WHEN o_orderkey % 20 = 16 THEN 'Group Stash' WHEN o_orderkey % 20 = 17 THEN 'Time Deposit - 6 months'
                    ELSE 'Unsecured Loan' END AS account_type,
               cast(o_totalprice as decimal(18,2)) AS trx_amount,
               split_part('Receive money from other Bank Account, ref|Send money to other Bank account|Blocking of funds|Payment|Receive money from other Bank Account', '|', cast(1 + o_orderkey % 5 as int)) AS core_narration
        FROM {orders}""",
    "accounts": """
        SELECT cast(o_custkey as string) AS ubcustomercode, '608' || cast(o_orderkey as string) AS accountid,
               o_orderdate - interval '10' day AS opendate,
               CASE WHEN o_orderstatus = 'F' THEN o_orderdate + interval '200' day END AS closuredate,
               CASE WHEN o_orderstatus = 'F' THEN 'Y' ELSE 'N' END AS closed,
               CASE WHEN o_orderkey % 20 < 15 THEN 'current' WHEN o_orderkey % 20 = 15 THEN 'savings'
                    WHEN o_orderkey % 20 = 16 THEN 'SaveForFuture' WHEN o_orderkey % 20 = 17 THEN 'fixdep' ELSE 'loan' END AS productid,
               CASE WHEN o_orderkey % 20 < 15 THEN 'Bank Account' WHEN o_orderkey % 20 = 15 THEN 'Individual Stash'
                    WHEN o_orderkey % 20 = 16 THEN 'Group Stash' WHEN o_orderkey % 20 = 17 THEN 'Time Deposit - 6 months'
                    ELSE 'Unsecured Loan' END AS accountdescription
        FROM {orders}""",
    "deposit_accounts": """
        SELECT cast(o_custkey as string) AS ubcustomercode,
               '7' || cast(l_orderkey as string) || '-' || cast(l_linenumber as string) || '-' || cast(l_partkey as string) AS accountid,
               l_shipdate AS opendate,
               CASE WHEN l_returnflag = 'R' THEN l_shipdate + interval '90' day END AS closuredate,
               CASE WHEN l_returnflag = 'R' THEN 'Y' ELSE 'N' END AS closed,
               CASE l_linenumber % 4 WHEN 0 THEN 'savings' WHEN 1 THEN 'fixdep' WHEN 2 THEN 'SaveForFuture' ELSE 'loan' END AS productid,
               CASE l_linenumber % 4 WHEN 0 THEN 'Individual Stash' WHEN 1 THEN 'Time Deposit - 6 months'
                    WHEN 2 THEN 'Group Stash' ELSE 'Unsecured Loan' END AS accountdescription
        FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey""",
    "balances": """
        SELECT '7' || cast(l_orderkey as string) || '-' || cast(l_linenumber as string) || '-' || cast(l_partkey as string) AS accountid,
               CASE l_linenumber % 4 WHEN 0 THEN 'Individual Stash' WHEN 1 THEN 'Time Deposit - 6 months'
                    WHEN 2 THEN 'Group Stash' ELSE 'Unsecured Loan' END AS account_type,
               CASE WHEN l_quantity < 45 THEN TIMESTAMP_NTZ '1994-12-31 00:00:00' ELSE l_shipdate END AS balancedateasof,
               CASE WHEN l_discount > 0.08 THEN cast(l_quantity as decimal(18,2)) ELSE cast(l_extendedprice as decimal(18,2)) END AS clearedbalance
        FROM {lineitem}""",
    "term_deposits": """
        SELECT '7' || cast(l_orderkey as string) || '-' || cast(l_linenumber as string) || '-' || cast(l_partkey as string) AS accountid,
               CASE WHEN l_linestatus = 'F' AND l_returnflag = 'A' THEN '4' WHEN l_linestatus = 'O' AND l_returnflag = 'A' THEN '9' ELSE '1' END AS status
        FROM {lineitem}""",
    "daily_balances": """
        SELECT cast(o_custkey as string) AS client_id, '7' || cast(l_orderkey as string) AS accountid,
               l_shipdate AS balancedateasof, l_linenumber AS line_no, l_partkey AS part_no,
               CASE WHEN l_discount > 0.05 THEN cast(l_quantity as decimal(18,2)) ELSE cast(l_extendedprice as decimal(18,2)) END AS clearedbalance
        FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey""",
    # three balances for each line, a week apart: an account has about 120 of them
    "balance_history": """
        SELECT cast(o_custkey as string) AS client_id, '7' || cast(o_custkey as string) AS accountid,
               l_shipdate + interval '1' day * shift AS balancedateasof, l_orderkey * 1000 + l_linenumber * 100 + shift AS entry_no, l_partkey AS part_no,
               CASE WHEN l_discount > 0.05 THEN cast(l_quantity as decimal(18,2)) ELSE cast(l_extendedprice as decimal(18,2)) END AS clearedbalance
        FROM (SELECT *, 0 AS shift FROM {lineitem} UNION ALL SELECT *, 7 FROM {lineitem} UNION ALL SELECT *, 14 FROM {lineitem}) l
             JOIN {orders} ON l_orderkey = o_orderkey""",
    "loans": """
        SELECT o_custkey AS customerId, 'DL' || cast(o_orderkey as string) AS digitalLoanAccountId,
               'LN' || cast(o_orderkey as string) AS loanAccountNumber,
               split_part('REJECT|COMPLETED|ACTIVATED|APPLIED|APPROVED|ACCEPT|EXPIRED', '|', cast(1 + o_orderkey % 7 as int)) AS applicationStatus,
               split_part('Quick|Flex|Flex-up|SIL', '|', cast(1 + o_orderkey % 4 as int)) AS new_loan_type,
               cast(CASE WHEN o_orderpriority = '1-URGENT' THEN 1 ELSE 0 END as int) AS reloan_flag,
               cast(CASE WHEN o_orderstatus = 'P' THEN 0 ELSE 1 END as int) AS flagApproval,
               cast(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END as int) AS flagDisbursement,
               o_orderdate + interval '9' hour AS startApplyDateTime,
               CASE WHEN o_orderstatus <> 'P' THEN o_orderdate + interval '2' day END AS approvedDateTime,
               CASE WHEN o_orderstatus <> 'P' THEN o_orderdate + interval '3' day END AS decision_date,
               CASE WHEN o_orderstatus = 'F' THEN o_orderdate + interval '5' day END AS disbursementdatetime,
               cast(6 + o_orderkey % 19 as int) AS loanRequestTenure,
               cast(CASE WHEN o_orderstatus <> 'P' THEN 3 + o_orderkey % 13 END as int) AS approvedLoanTenure,
               cast(o_totalprice as decimal(18,2)) AS loanRequestAmount,
               CASE WHEN o_orderstatus <> 'P' THEN cast(o_totalprice as decimal(18,2)) END AS approvedLoanAmount,
               CASE WHEN o_orderstatus = 'F' THEN cast(o_totalprice as decimal(18,2)) END AS disbursedLoanAmount,
               cast(CASE WHEN o_orderkey % 11 = 0 THEN 1 ELSE 0 END as int) AS obsFPD10,
               cast(CASE WHEN o_orderkey % 13 = 0 THEN 1 ELSE 0 END as int) AS obsFPD30,
               cast(o_orderkey % 200 as int) AS Max_Ever_DPD,
               CASE WHEN o_orderkey % 3 = 0 THEN NULL WHEN o_orderkey % 3 = 1 THEN 'Single' ELSE 'Married' END AS maritalStatus,
               CASE WHEN o_orderkey % 3 = 0 OR o_orderkey % 5 = 0 THEN NULL ELSE cast(o_orderkey % 6 as string) END AS dependentsCount,
               CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE cast(10000 + o_orderkey % 9000 as string) END AS monthlyIncome
        FROM {orders}""",
    "loan_details": """
        SELECT 'LN' || cast(l_orderkey as string) AS accountid, cast(l_linenumber as string) AS numberofwholerepays
        FROM {lineitem}""",
    "loan_repayments": """
        SELECT 'LN' || cast(l_orderkey as string) AS accountid, cast(l_extendedprice as decimal(18,2)) AS repaymentpaid
        FROM {lineitem}""",
    "loan_buckets": """
        SELECT 'LN' || cast(l_orderkey as string) AS loanAccountNumber, cast(l_shipdate as date) AS bucketDate
        FROM {lineitem}""",
    "delinquency": """
        SELECT 'LN' || cast(o_orderkey as string) AS loanAccountNumber, cast(o_orderkey % 4 as int) AS min_inst_def30
        FROM {orders}""",
    "postings": """
        SELECT cast(o_orderkey as string) AS transactionid,
               CASE WHEN o_orderkey % 6 = 0 THEN '700' ELSE '608' END || cast(o_orderkey as string) AS accountid,
               o_orderdate + interval '30' minute AS postingdate,
               split_part('N01|IP2|XE2|00T|21C|P01|A01|BP1|BP2', '|', cast(1 + o_orderkey % 9 as int)) AS code,
               CASE WHEN o_orderstatus = 'F' THEN 'C' ELSE 'D' END AS debitcreditflag,
               split_part('Receive money|Send money|Blocking of funds|Payment|Top up', '|', cast(1 + o_orderkey % 5 as int)) AS narration,
               cast(o_totalprice as decimal(18,2)) AS amount
        FROM {orders}""",
    "campaign_events": f"""
        SELECT user_id AS customer_id, event_id, ts - interval '{CONTACT_SHIFT_DAYS}' day AS event_time,
               CASE event_type
                 WHEN 'view' THEN split_part('Email Opened|Mobile In-App Shown|Notification Received Android|Notification Sent iOS|SMS Sent', '|', cast(1 + k % 5 as int))
                 WHEN 'click' THEN split_part('Mobile In-App Clicked|Notification Clicked Android|Notification Clicked iOS', '|', cast(1 + k % 3 as int))
                 WHEN 'purchase' THEN split_part('App_Launch|Loans_QL_Calculator|Loans_QL_Launch|Loans_SIL_Launch', '|', cast(1 + k % 4 as int))
                 WHEN 'error' THEN 'Loans_Selection'
                 ELSE split_part('Email Delivered|Email Sent', '|', cast(1 + k % 2 as int)) END AS event_name,
               event_type AS event_code,
               'C' || cast(k % 9 as string) AS campaign_name,
               split_part('PUSH|EMAIL|SMS|INAPP', '|', cast(1 + k % 4 as int)) AS campaign_channel,
               CASE WHEN event_type = 'error' THEN split_part('Quick_Loan|Shop_Installment_Loan|Other', '|', cast(1 + k % 3 as int)) END AS clicked
        FROM (SELECT *, cast(regexp_extract(props, '([0-9]+)', 1) as int) AS k FROM {{events}}) e""",
    "campaign_list": """
        SELECT DISTINCT 'C' || cast(k % 9 as string) AS campaign_name,
               CASE k % 9 WHEN 0 THEN 'Product Bundle' WHEN 1 THEN 'Any Activity' WHEN 2 THEN 'Loan Decision'
                    WHEN 3 THEN 'Stash Opening' WHEN 4 THEN 'Cross Sell' WHEN 5 THEN 'Win Back' WHEN 6 THEN 'Product Bundle' END AS campaign_group
        FROM (SELECT cast(regexp_extract(props, '([0-9]+)', 1) as int) AS k FROM {events}) e""",
    "installs": f"""
        SELECT 'AF' || cast(event_id as string) AS install_id,
               CASE WHEN k < 5 THEN NULL ELSE cast(user_id as string) END AS customer_user_id,
               ts - interval '{INSTALL_SHIFT_DAYS}' day AS install_time,
               cast(ts - interval '{INSTALL_SHIFT_DAYS}' day as date) AS partition_date,
               CASE WHEN event_id % 2 = 0 THEN 'paid' ELSE 'organic' END AS source_table,
               CASE WHEN k % 11 = 0 THEN NULL ELSE split_part('{"|".join(RAW_SOURCES)}', '|', cast(1 + (k + event_id) % {len(RAW_SOURCES)} as int)) END AS media_source,
               CASE WHEN k % 11 = 0 AND k % 2 = 0 THEN 'Partnership' END AS partner,
               CASE WHEN k % 13 = 0 THEN 'refer_winter' WHEN k % 5 = 0 THEN 'spring' END AS campaign
        FROM (SELECT *, cast(regexp_extract(props, '([0-9]+)', 1) as int) AS k FROM {{events}} WHERE event_type = 'signup') e""",
    "gps": """
        SELECT cast(o_custkey as string) AS customer_id,
               CASE WHEN s_nationkey = 24 THEN 'undefined' ELSE '14.' || cast(s_nationkey as string) END AS latitude,
               CASE WHEN s_nationkey = 24 THEN 'undefined' ELSE '121.' || cast(s_nationkey % 5 as string) END AS longitude,
               CASE l_returnflag WHEN 'A' THEN 'Apigee Logs' WHEN 'N' THEN 'Onboarding' ELSE 'Loan Journey' END AS event_description,
               cast(l_shipdate as date) AS SourceAsofDate,
               l_shipdate + interval '1' minute * (l_orderkey % 1440) AS gps_collection_date
        FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey JOIN {supplier} ON l_suppkey = s_suppkey""",
    "geocodes": """
        SELECT cast(o_custkey as string) AS customer_id,
               CASE WHEN l_linestatus = 'F' THEN '14.' ELSE '15.' END || cast(s_nationkey as string) AS latitude,
               '121.' || cast(s_nationkey % 5 as string) AS longitude, l_shipdate AS date_time, r_name AS country, n_name AS state, 'County ' || cast(l_linenumber as string) AS county,
               'City ' || cast(n_nationkey as string) AS city, CASE WHEN n_nationkey % 3 = 0 THEN n_name END AS municipality,
               cast(1000 + n_nationkey as string) AS postcode, 'Road ' || cast(l_orderkey as string) AS road,
               'S' || cast(n_nationkey as string) AS state_code,
               CASE WHEN l_returnflag = 'A' THEN 'street' ELSE 'city' END AS result_type,
               n_name || ', ' || r_name AS formatted, n_name AS address_line1, r_name AS address_line2
        FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey JOIN {supplier} ON l_suppkey = s_suppkey
             JOIN {nation} ON s_nationkey = n_nationkey JOIN {region} ON n_regionkey = r_regionkey""",
    "customer_details": f"""
        SELECT cast(c_custkey as string) AS custId,
               CASE WHEN c_acctbal < -500 THEN 'not given' WHEN c_acctbal < -400 THEN NULL
                    ELSE cast(1 + c_custkey % 28 as string) || ' ' || split_part('Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec', '|', cast(1 + c_custkey % 12 as int))
                         || ' ' || cast(1950 + c_custkey % 55 as string) END AS dateOfBirth,
               'SA' || cast(c_custkey as string) AS signUpAccNo,
               CASE WHEN c_acctbal < 0 THEN 'BKYC' WHEN c_acctbal < 100 THEN NULL ELSE 'SKYC' END AS kycStatus,
               'Street ' || cast(c_custkey % 90 as string) AS addressline1,
               CASE WHEN c_acctbal > 4000 THEN 'City ' || cast(c_nationkey as string) END AS city,
               CASE WHEN c_acctbal > 3000 THEN 'Province ' || cast(c_nationkey as string) END AS province,
               CASE WHEN c_acctbal > 2000 THEN 'Barangay ' || cast(c_nationkey as string) END AS barangay,
               'PC' || cast(c_nationkey as string) AS provinceCode,
               CASE WHEN c_acctbal > 1000 THEN cast(1000 + c_nationkey as string) END AS postalcode,
               'Mail City ' || cast(c_nationkey as string) AS mailingCity, cast(2000 + c_nationkey as string) AS mailingPostalCode,
               'Mail Province ' || cast(c_nationkey as string) AS mailingProvince,
               c_mktsegment AS natureofwork, CASE WHEN c_custkey % 2 = 0 THEN 'Employed' ELSE 'Self-employed' END AS employmentstatus,
               CASE WHEN c_custkey % 3 = 0 THEN 'iOS' ELSE 'Android' END AS mobileOs, 'ID' || cast(c_custkey % 4 as string) AS docType,
               CASE WHEN c_acctbal < -900 THEN 'unknown' ELSE
                 cast({CREATED.format(k='c_custkey')} + interval '1' second * (c_custkey % 5000 - 2000) as string) || '.250000' END AS onboardingDate,
               {CREATED.format(k='c_custkey')} AS created_dt,
               'Company ' || cast(c_custkey % 40 as string) AS companyName, 'Industry ' || cast(c_custkey % 9 as string) AS industry,
               'Model ' || cast(c_custkey % 7 as string) AS device_dtl,
               'R' || cast(c_custkey as string) AS deviceRef
        FROM {{customer}}""",
    "education": """
        SELECT 'DL' || cast(l_orderkey as string) AS digitalLoanAccountId, lpad(cast(p_size as string), 3, '0') AS education_id
        FROM {lineitem} JOIN {part} ON l_partkey = p_partkey""",
    "education_lookup": """
        SELECT DISTINCT lpad(cast(p_size as string), 3, '0') AS id, 'Level ' || cast(p_size as string) AS description,
               CASE WHEN p_size % 6 = 0 THEN 'Purpose' ELSE 'Education' END AS module
        FROM {part}""",
    "customer_address": """
        SELECT 'U' || cast(c_custkey as string) AS user_id, cast(1000 + c_nationkey as string) AS hm_postalcode,
               'Barangay ' || cast(c_nationkey as string) AS hm_barangay, 'City ' || cast(c_nationkey as string) AS hm_city,
               CASE c_nationkey WHEN 3 THEN 'KALINGA' WHEN 4 THEN 'OCCIDENTAL MINDORO' WHEN 5 THEN 'ORIENTAL MINDORO' WHEN 6 THEN 'ORODNIM'
                    WHEN 7 THEN 'SAMAR (WESTERN SAMAR)' WHEN 8 THEN 'ZAMBOANGA SIBUGAY' ELSE upper(n_name) END AS hm_province
        FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey""",
    "region_map": """
        SELECT lower(n_name) AS province, r_name AS Region_name FROM {nation} JOIN {region} ON n_regionkey = r_regionkey""",
    "carrier_map": """
        SELECT cast(905 + n_nationkey as bigint) AS number_prefix,
               CASE n_regionkey WHEN 0 THEN 'Globe' WHEN 1 THEN 'Smart' WHEN 2 THEN 'Dito' ELSE 'Globe' END AS network_group,
               'mobile' AS network
        FROM {nation}
        UNION ALL
        SELECT cast((905 + n_nationkey) * 10 as bigint), 'Globe Postpaid', 'postpaid' FROM {nation} WHERE n_regionkey = 0""",
    "financial_profile": """
        SELECT 'D' || cast(c_custkey as string) AS deviceId, c_custkey % 5 AS sourceOfFundKey,
               c_nationkey + CASE WHEN c_custkey % 50 = 0 THEN 100 ELSE 0 END AS employmentStatusKey,
               CASE WHEN c_acctbal < 0 THEN 'n/a' ELSE cast(8000 + c_custkey % 700 as string) END AS monthly_income
        FROM {customer}""",
    "source_of_funds": "SELECT r_regionkey AS id, 'Funds ' || r_name AS description FROM {region}",
    "employment_status": "SELECT n_nationkey AS id, 'Job ' || n_name AS description FROM {nation}",
    "device_track": f"""
        SELECT 'R' || cast(c_custkey as string) AS refno,
               {CREATED.format(k='c_custkey')} + interval '1' day * (c_custkey % 150) AS createdOn,
               cast(300 + c_custkey % 500 as string) AS creditScoreUpdated, cast(c_custkey % 100 as string) AS fraudScore,
               cast(c_custkey % 90 as string) AS fraudScoreUpdated
        FROM {{customer}}""",
    "device_rows": """
        SELECT 'R' || cast(o_custkey as string) AS deviceId, l_shipdate AS run_date, p_brand AS brand, p_brand AS device__brand,
               p_type AS device__manufacturer, 'M' || cast(p_size as string) AS device__model,
               'Operator ' || cast(l_linenumber % 3 as string) AS telephony_info__network_operator_name,
               '5150' || cast(l_linenumber % 3 as string) AS telephony_info__network_operator,
               'SIM ' || cast(l_linenumber % 2 as string) AS sim_operator_name,
               CASE WHEN p_size = 1 THEN 'com.LinkedIn.android' WHEN p_size = 2 THEN 'ms.Word_office'
                    ELSE replace(p_name, ' ', '_') || '.' || p_brand END AS package_1,
               l_shipdate - interval '30' day AS installed_1,
               'com.vendor ' || p_type AS package_2, l_shipdate - interval '400' day AS installed_2,
               CASE WHEN l_quantity < 5 THEN 0 WHEN l_quantity < 25 THEN 1 ELSE 2 END AS n_apps
        FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey JOIN {part} ON l_partkey = p_partkey""",
    "app_catalogue": f"""
        SELECT package_name, split_part('{"|".join(APP_CATEGORIES)}|a kind of its own', '|', cast(1 + min(p_partkey) % {len(APP_CATEGORIES) + 1} as int)) AS category,
               split_part('rated for 3+|rated for 12+|rated for 16+|rated for 18+', '|', cast(1 + min(p_size) % 4 as int)) AS rating,
               CASE WHEN min(p_size) % 7 = 0 THEN NULL ELSE 'content ' || cast(min(p_size) % 3 as string) END AS rating_description,
               CASE WHEN min(p_size) % 8 = 7 THEN NULL WHEN min(p_size) % 4 = 0 THEN 'pay' WHEN min(p_size) % 4 = 3 THEN 'undefined' ELSE 'free' END AS is_paid
        FROM (SELECT *, CASE WHEN p_size = 1 THEN 'com.LinkedIn.android' WHEN p_size = 2 THEN 'ms.Word_office'
                             ELSE p_name || '.' || p_brand END AS package_name FROM {{part}}) p
        GROUP BY package_name""",
    "observed_balances": """
        SELECT cast(c_custkey as string) AS customer_id,
               CASE WHEN c_acctbal > 500 THEN cast(c_acctbal as double) END AS tx_tsa_balance_4m,
               CASE WHEN c_acctbal > 700 THEN cast(c_acctbal as double) END AS tx_tsa_balance_5m,
               cast(c_nationkey as double) AS tx_stash_balance_4m, cast(c_nationkey + 1 as double) AS tx_stash_balance_5m
        FROM {customer}""",
}

#: Roles that Spark builds by another text with the same rows: each line meets its order once, not once per balance.
SPARK_SQL = {
    "balance_history": """
        SELECT cast(o_custkey as string) AS client_id, '7' || cast(o_custkey as string) AS accountid,
               l_shipdate + interval '1' day * shift AS balancedateasof, l_orderkey * 1000 + l_linenumber * 100 + shift AS entry_no, l_partkey AS part_no,
               CASE WHEN l_discount > 0.05 THEN cast(l_quantity as decimal(18,2)) ELSE cast(l_extendedprice as decimal(18,2)) END AS clearedbalance
        FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey LATERAL VIEW explode(array(0, 7, 14)) s AS shift""",
}

#: Roles that can read lines joined with their orders once (``order_lines``), and the columns of a line they read.
OF_LINES = ("deposit_accounts", "gps", "geocodes", "device_rows")
LINE_COLUMNS = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_shipdate", "l_returnflag", "l_linestatus")

_TABLE = re.compile(r"\{(\w+)\}")


@lru_cache(maxsize=None)
def role_sql(role: str) -> str:
    """Role text for DuckDB, over views named like the parquet tables."""
    return _TABLE.sub(r"\1", ROLE_SQL[role]).replace("TIMESTAMP_NTZ", "TIMESTAMP")


def order_lines(tables: Tables) -> DataFrame:
    """Lines with the customer of their order, as several roles join them: for callers that store them once."""
    return tables.lineitem.join(tables.orders, F.col("l_orderkey") == F.col("o_orderkey")).select(*LINE_COLUMNS, "o_custkey")


def role(tables: Tables, name: str, lines: DataFrame | None = None) -> DataFrame:
    """Role as a lazy DataFrame; ``lines`` are stored ``order_lines``."""
    text = SPARK_SQL.get(name) or ROLE_SQL[name]
    if lines is not None and name in OF_LINES:
        text = text.replace("{lineitem} JOIN {orders} ON l_orderkey = o_orderkey", "{order_lines}")
    return tables.spark.sql(text, **{t: lines if t == "order_lines" else getattr(tables, t) for t in set(_TABLE.findall(text))})


def device_dump(rows: DataFrame) -> DataFrame:
    """Device dump with nested attribute groups."""
    return rows.select(
        "deviceId", "run_date", F.struct("brand").alias("GeneralInfo"),
        F.struct("device__brand", "device__manufacturer", "device__model").alias("Hardware"),
        F.struct("telephony_info__network_operator_name", "telephony_info__network_operator",
                 "sim_operator_name").alias("GeneralData"))


def device_apps(rows: DataFrame) -> DataFrame:
    """Installed apps of each dump as an array of structs, possibly empty."""
    app = [F.struct(F.col(f"package_{i}").alias("package_name"), F.col(f"installed_{i}").alias("first_install_time"))
           for i in (1, 2)]
    return rows.select("deviceId", "run_date", F.slice(F.array(*app), F.lit(1), F.col("n_apps").cast("int")).alias("Application"))
